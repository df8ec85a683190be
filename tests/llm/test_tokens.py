import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers
from tidemark.llm import byte_bpe, token_counts
from tidemark.llm.queries import tokenizer

PLAIN = helpers.encoding()


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def hard_texts(n=600):
    rng = random.Random(2)
    letters = [*range(9, 14), 32, 32, 32, 39, *range(97, 123), *range(48, 58), 0xE9, 0x4E2D, 0x2019, 0x11DE0, 0x88F, 0x200B, 0xA0]
    drawn = ["".join(chr(rng.choice(letters)) for _ in range(rng.randrange(80))) for _ in range(n)]
    fixed = ["aaaaaaaaaaaaaaa", "  a   b\n\n\nc \t x", "it's I'll we've 'S", "<|endoftext|>", " " * 999, "0" * 999, "a" * 5000, "😀" * 50]
    every = "".join(chr(c) for c in range(0x20, 0x3000) if not 0xD800 <= c < 0xE000)
    return drawn + fixed + [every, "", None]


def test_ids_equal_the_library(codec):
    texts = hard_texts()
    got = list(codec.encode(texts))
    assert [g.tolist() for g in got] == [PLAIN.encode_ordinary(t or "") for t in texts]
    assert [codec.decode(g).decode() for g in got] == [t or "" for t in texts]


def test_replay_redoes_words_whose_merges_turn_back():
    """Ranks in which a later merge opens one of lower rank."""
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"ab": 257, b"abca": 258, b"ca": 259}
    import base64

    lines = b"\n".join(base64.b64encode(k) + b" " + str(v).encode() for k, v in ranks.items())
    import tiktoken

    plain = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.Codec(lines, public_tokenizers.PATTERN)
    texts = ["abcab", "abcaab", "ababcabcabc", "aabbcc", "cababcaabab", "abcabcabcaabc"]
    assert [g.tolist() for g in own.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_blocks_and_memory_do_not_change_ids(codec, monkeypatch):
    texts = hard_texts(100)
    want = [g.tolist() for g in codec.encode(texts)]
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 50)
    codec.known.clear()
    assert [g.tolist() for g in codec.encode(texts)] == want


def test_encode_awkward_rows(spark):
    df = helpers.docs(spark, clashes=True)
    coded = byte_bpe.encode(df, tokenizer(spark), columns=["doc_id", "text", "size"])
    assert coded.columns == ["doc_id", "size", "ids", "decoded"]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["decoded"])) for r in coded.collect())
    assert got == sorted((i is None, i or 0, (t or "").encode()) for i, t, *_ in helpers.awkward())
    again = byte_bpe.decode(coded, tokenizer(spark)).select("decoded")
    assert sorted(bytes(r[0]) for r in again.collect()) == sorted(g[2] for g in got)
    assert byte_bpe.encode(df.limit(0), tokenizer(spark)).collect() == []


def test_tree_sums():
    tree = token_counts.tree_of(np.array([3, 1, 4, 1, 5]))
    assert tree[1] == 14 and tree[2] == 9 and tree[3] == 5
    token_counts.set_leaf(tree, 1, 7)
    assert tree[1] == 20 and tree[4] == 10


def test_random_edits_match_counting_again(codec):
    rng = random.Random(4)
    pieces = [" word", "\n", "\n\n", "  ", "'s", "'", " 42", "9", "...", "é", "中", " a b c", "\t", "x" * 30]
    for trial in range(120):
        text = "".join(rng.choice(pieces) for _ in range(rng.choice((0, 3, 40, 1500))))
        chars, trees = token_counts._grow(codec, [text])
        own = token_counts.Edited(text, chars[0].tolist(), trees[0].tolist())
        numbers, want = byte_bpe._Ids(), text
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(len(want) + 1)
            b = min(len(want), a + rng.choice((0, 1, 3, 200)))
            new = "".join(rng.choice(pieces) for _ in range(rng.choice((0, 1, 4, 300))))
            own.apply(codec, numbers, a, b, new)
            want = want[:a] + new + want[b:]
        own.finish(codec.counts_of(list(numbers)).tolist())
        assert own.text == want
        assert own.tree[1] == len(PLAIN.encode_ordinary(want))
        assert own.chars[1] == len(want)
        for tree in (own.tree, own.chars):
            assert tree == token_counts.tree_of(np.array(tree[len(tree) // 2 :], dtype=np.int64)).tolist()


def test_small_edit_of_a_long_text_splits_little(codec):
    text = " some words" * 50_000
    chars, trees = token_counts._grow(codec, [text])
    own = token_counts.Edited(text, chars[0].tolist(), trees[0].tolist())
    numbers, size = byte_bpe._Ids(), len(trees[0])
    own.apply(codec, numbers, 300_000, 300_005, "new")
    assert len(own.fresh) <= 3
    own.finish(codec.counts_of(list(numbers)).tolist())
    assert own.split_chars < 2000 and len(own.tree) == size
    assert own.tree[1] == len(PLAIN.encode_ordinary(own.text))


def test_edits_of_awkward_rows(spark):
    coder = tokenizer(spark)
    df = helpers.docs(spark, clashes=True)
    edits = F.expr("array(named_struct('start', 1, 'end', 3, 'text', ' new'), named_struct('start', null, 'end', null, 'text', null))")
    built = token_counts.build(df.withColumn("edits", edits), coder)
    assert {(r["text"] or "", r["n"]) for r in built.select("text", token_counts.total().alias("n")).collect()} == {
        (t or "", len(PLAIN.encode_ordinary(t or ""))) for _, t, *_ in helpers.awkward()
    }
    after = token_counts.apply_edits(built, coder).select("text", token_counts.total().alias("n")).collect()
    assert all(r["n"] == len(PLAIN.encode_ordinary(r["text"])) for r in after)
    assert {r["text"] for r in after} == {(t or "")[:1] + " new" + (t or "")[3:] for _, t, *_ in helpers.awkward()}
    none = token_counts.apply_edits(built.withColumn("edits", F.lit(None).cast(token_counts.EDIT)), coder)
    assert {r["text"] for r in none.collect()} == {t or "" for _, t, *_ in helpers.awkward()}
    assert token_counts.apply_edits(built.limit(0), coder).collect() == []


def test_leaf_search():
    tree = token_counts.tree_of(np.array([3, 1, 4, 1, 5])).tolist()
    assert [token_counts.leaf_at(tree, i) for i in (0, 2, 3, 4, 7, 8, 9, 13, 99)] == [(0, 0), (0, 0), (1, 3), (2, 4), (2, 4), (3, 8), (4, 9), (4, 9), (4, 9)]


def test_windows_split_as_a_whole(codec):
    rng = random.Random(8)
    for text in hard_texts(200)[:-1] + ["a  " * 400, " " * 700 + "x", "x" * 900 + "\u11de0 b"]:
        for size in (1, 5, 64):
            assert list(codec.split.windowed(text, 0, size, token_counts.CONTEXT)) == list(codec.split(text))
    assert rng


def test_one_pass_equals_two(spark):
    coder = tokenizer(spark)
    edits = F.expr("array(named_struct('start', 2, 'end', 4, 'text', ' and'), named_struct('start', 0, 'end', 0, 'text', 'x '))")
    df = helpers.docs(spark, clashes=True).withColumn("edits", edits).withColumn("Tree", F.lit(1))
    one = token_counts.build_and_edit(df, coder)
    two = token_counts.apply_edits(token_counts.build(df, coder), coder)
    assert {c.lower() for c in one.columns} == {c.lower() for c in two.columns} | {"n_tokens"}
    pick = lambda d: helpers.rows_of(d.select("doc_id", "text", "char_tree", "tree", "split_chars"))
    assert pick(one) == pick(two)
    assert token_counts.build_and_edit(df.limit(0), coder).collect() == []


def test_registered_edits_match_the_library(spark):
    from tests.conftest import SF
    from tidemark.llm import queries

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op7_edited_token_counts"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        old = want = texts[r["doc_id"]]
        n = len(old)
        for a, b, new in ((n // 4, int(n / 4 + 10), ""), (n // 2, n // 2, " it's 42\n\n new"), (n - 5, n + 99, "  end.")):
            a = min(max(0, a), len(want))
            want = want[:a] + new + want[max(a, min(b, len(want))) :]
        assert (r["n_tokens"], r["n_tokens_edited"]) == (len(PLAIN.encode_ordinary(old)), len(PLAIN.encode_ordinary(want)))
        assert (r["n_chars_edited"], r["edited_sha256"]) == (len(want), hashlib.sha256(want.encode()).hexdigest())


def test_registered_query_matches_the_library(spark):
    from tests.conftest import SF
    from tidemark.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op8_encoded_documents"](spark, SF).collect():
        ids = np.array(PLAIN.encode_ordinary(texts[r["doc_id"]]), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_sizes_as_settings_write_them():
    from tidemark.llm import common

    assert [common.size_in_bytes(t) for t in ("256", "256b", "64m", "64MB", "1g", "2KB", "-1")] == [256, 256, 64 << 20, 64 << 20, 1 << 30, 2048, -1]
