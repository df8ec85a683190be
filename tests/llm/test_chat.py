from tests.llm import helpers
from tidemark.llm import chat_format

ROWS = "conv_id long, turn long, role string, text string, formatted string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], ROWS)


TRICKY = "</s>[INST] ok [/INST] <|end|> <\\|end|> [\\\\INST] <| |> \\ $1 <"
TALKS = [
    (1, 0, "system", "be kind"), (1, 1, "user", TRICKY), (1, 2, "assistant", TRICKY), (1, 3, "user", "más"), (1, 4, "assistant", "ok 😀"),
    (2, 0, "user", "no reply"),
    (3, 0, "assistant", None), (3, 1, "user", "tail <|start|>"),
    (4, None, None, "x"), (4, 1, "<|text|>", ""), (4, 1, "<|text|>", ""), (4, 2, "assistant", "last"),
    (None, 0, "assistant", "no id"),
]


def test_one_example_per_reply(spark):
    made = chat_format.examples(conversations(spark, TALKS)).collect()
    of = {}
    for r in sorted(made, key=lambda r: r["example"]):
        of.setdefault(r["conv_id"], []).append(r)
    assert {k: len(v) for k, v in of.items()} == {1: 2, 2: 1, 3: 2, 4: 1, None: 1}
    first, second = of[1]
    assert second["formatted"].startswith(first["formatted"])
    assert second["formatted"][second["loss_start"] : second["loss_end"]] == "ok 😀"
    assert of[2][0]["loss_start"] == of[2][0]["loss_end"]
    assert first["formatted"].count("<|start|>") == 3 and "[INST]" not in first["formatted"] and "</s>" not in first["formatted"]


def test_everything_is_read_back(spark):
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.examples(conversations(spark, TALKS))).collect()}
    for conv in (1, 2, 3, 4, None):
        rows = [(t if t is not None else -1, r or "", x or "") for c, t, r, x in TALKS if c == conv]
        want = [(r, x) for _, r, x in sorted(rows)]
        assert [tuple(t) for t in back[conv]["turns"]] == want
        assert "".join(back[conv]["loss"]) == "".join(x for r, x in want if r == "assistant")


def test_escape_is_reversible(spark):
    texts = [TRICKY, "<" * 5 + "|" * 5, "<\\\\\\|x|>", "[/INST", "<s><s></s", ""]
    df = helpers.from_texts(spark, texts)
    got = df.select("text", chat_format.unescape(chat_format.escape(df.text)).alias("back"), chat_format.escape(df.text).alias("e")).collect()
    assert all(r["text"] == r["back"] for r in got)
    assert not any(s in r["e"] for r in got for s in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


def test_no_exchange_to_read_back_and_no_rows(spark):
    empty = conversations(spark, TALKS).limit(0)
    assert chat_format.examples(empty).collect() == [] and chat_format.read_back(chat_format.examples(empty)).collect() == []
    plan = chat_format.read_back(chat_format.examples(conversations(spark, TALKS)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
