"""Importance resampling, language identification and token alignment against plain versions."""

import collections
import hashlib
import json
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from tests.llm import helpers
from tidemark.llm import importance, language_id, queries, token_alignment

# ---------------------------------------------------------------- importance resampling


def plain_features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % 10_000 for g in grams]


def plain_draw(rows, target, percent=5):
    """``(id, n_features, weight, score, rank)`` of every row."""
    held = [(i, *plain_features(t)) for i, t in rows]
    s, t = collections.Counter(), collections.Counter()
    for _, _, f in held:
        s.update(f)
    for x in target:
        t.update(plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in held:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = collections.defaultdict(list)
    for rank, x in enumerate(order[: percent * len(order) // 100], 1):
        drawn[x].append(rank)
    return sorted(((i, f, w, s, (drawn[i, n, f, w, s] or [None]).pop(0) if drawn[i, n, f, w, s] else None) for i, n, f, w, s in out), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZ09 .-\n\x00\x7fé中😀")), max_size=60))
def test_scan_finds_every_run(text):
    n, found = importance.crcs(text, importance.spans())
    words, want = plain_features(text)
    assert n == words
    assert sorted(int(x) % 10_000 for part in found for x in part) == sorted(want)


def test_scan_in_chunks(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500))
    whole = sorted(np.concatenate(importance.crcs(text, importance.spans())[1]).tolist())
    monkeypatch.setattr(importance, "_CHUNK", 7)
    n, found = importance.crcs(text, importance.spans())
    assert n == 500 and sorted(np.concatenate(found).tolist()) == whole


def test_gains_lean_to_the_target():
    gain = importance.gains(np.array([10, 10, 0]), np.array([0, 10, 10]))
    assert gain[0] < 0 < gain[2] and gain[1] == math.floor(1000 * math.log(11 * 23 / (11 * 23)))


def test_resampling_matches_plain_version(spark):
    got = queries.resampled_documents(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_draw(docs, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert helpers.rows_of(got) == want
    assert sum(r[4] is not None for r in want) == sum(plain_features(t)[0] >= 20 for _, t in docs) * 5 // 100


def test_resampling_awkward_rows(spark):
    rows = helpers.awkward() + [(100 + i // 2, " ".join(f"w{i % 5}x{j}" for j in range(25)), None, None, None) for i in range(80)]
    df = helpers.docs(spark, rows, clashes=True).selectExpr("*", "'7' as rank", "7 as _row", "7 as buckets")
    target = spark.createDataFrame([("w0x1 w0x2 w0x3",), (None,), ("",)], "text string")
    got = importance.resample(df, target, percent=50)
    assert {"size", "findings", "lang"} <= {c.lower() for c in got.columns} and len(set(got.columns)) == len(got.columns)
    want = plain_draw([(r[0], r[1]) for r in rows], ["w0x1 w0x2 w0x3"], 50)
    # Rows of equal id and score are told apart by their place only.
    plain = lambda x: sorted(((r[0], r[1], r[2], r[3]) for r in x), key=repr)
    found = [tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert plain(found) == plain(want)
    assert sorted(r[4] for r in found if r[4]) == sorted(r[4] for r in want if r[4])
    at = lambda x: {r[4]: r[:4] for r in x if r[4]}
    assert at(found) == at(want)
    assert importance.resample(df.limit(0), target).collect() == []
    assert importance.resample(df, target.limit(0)).count() == len(rows)


def test_ranks_of_many_equal_scores(spark):
    """A third of all rows with one id and one text: every rank is given once."""
    rows = [(1, "same words again " * 10, None, None, None)] * 300 + [(i, f"text {i} " * 15, None, None, None) for i in range(2, 600)]
    got = importance.resample(helpers.docs(spark, rows).repartition(13), helpers.docs(spark, rows[:1]), percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))
    assert [r["score"] for r in sorted(got, key=lambda r: r["rank"])] == sorted((r["score"] for r in got), reverse=True)


# ---------------------------------------------------------------- language identification


def test_windows_cover_every_byte():
    for size in (0, 1, 127, 128, 129, 500):
        data = np.arange(size, dtype=np.uint8) | 1
        cut = language_id.windows(data)
        assert np.concatenate([w[: language_id.LENGTH] for w in cut])[:size].tolist() == data.tolist()
        assert all(a[language_id.LENGTH :].tolist() == b[:3].tolist() for a, b in zip(cut, cut[1:]))


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    net = language_id.Network.fresh(["a", "b", "c"], rng)
    for name in ("embedding", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rows, truth = rng.integers(1, 30, (6, language_id.LENGTH + 3)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        p = net.probabilities(net.pooled(rows, net.tables())[0])
        return -np.log(p[np.arange(6), truth]).mean()

    for x, g in zip(net.parts(), language_id._gradient(net, rows, truth)):
        for at in list(zip(*np.nonzero(g)))[:6]:
            kept = x[at]
            x[at] = kept + 1e-6
            up = loss()
            x[at] = kept - 1e-6
            down = loss()
            x[at] = kept
            assert abs((up - down) / 2e-6 - g[at]) < 1e-4 * max(1, abs(g[at]))


def test_pair_tables_equal_the_convolution():
    rng = np.random.default_rng(1)
    net = language_id.Network.fresh(["a", "b"], rng)
    rows = rng.integers(0, 256, (3, language_id.LENGTH + 3)).astype(np.uint8)
    answers = net.pooled(rows, net.tables())[1]
    e = net.embedding[rows]
    want = sum(np.einsum("npe,ef->npf", e[:, t : t + language_id.LENGTH], net.filters[t]) for t in range(4))
    assert np.allclose(answers, want, atol=1e-4)


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.identified_languages(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    tested = [r["lang_pred"] == truth[r["doc_id"]][0] for r in got if r["held_out"] and truth[r["doc_id"]][0]]
    assert len(tested) > 250 and np.mean(tested) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_rows_and_columns_teach_nothing(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"))
    other = docs.withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang"))).withColumn("text", F.when(out, F.lit("x")).otherwise(F.col("text")))
    a, b = (language_id.sampled_windows(d.filter(~out)) for d in (docs, other))
    assert a[2] == b[2] and np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_language_awkward_rows(spark):
    df = helpers.docs(spark, clashes=True).selectExpr("*", "7 as score", "'7' as Lang_pred")
    net = language_id.fit(df, per_label=50)
    got = language_id.identify(df, net)
    assert len({c.lower() for c in got.columns}) == len(got.columns) and "text" not in got.columns
    texts = [t for _, t, *_ in helpers.awkward()]
    found = collections.Counter(r["lang_pred"] == "und" for r in got.collect())
    assert found[True] == sum(not re.search("[a-z]", t or "", re.I) for t in texts)
    assert language_id.judge(net, ["123 !?", "", None])[0] == ["und"] * 3
    assert language_id.identify(df.limit(0), net).collect() == []
    empty = language_id.fit(df.limit(0))
    assert {tuple(r) for r in language_id.identify(df, empty, columns=[]).collect()} == {("und", 0.0)}


def test_sample_is_bounded(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else None, None, None) for i in range(3000)] + [(None, "same text", "fr", None, None)] * 1500
    data, truth, labels = language_id.sampled_windows(helpers.docs(spark, rows), per_label=100)
    assert labels in (["en"], ["en", "fr"]) and 60 < (truth == 0).sum() < 150 and (truth == 1).sum() <= 1


def test_long_text_is_judged_whole():
    rng = np.random.default_rng(3)
    make = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    rows = [language_id.windows(language_id.encoded(make(letters, 100))) for letters in ("abcd", "wxyz") for _ in range(40)]
    net = language_id.train(np.concatenate(rows), np.repeat([0, 1], [sum(map(len, rows[:40])), sum(map(len, rows[40:]))]), ["a", "w"])
    long = make("abcd", 3000) + " " + make("wxyz", 60_000)
    labels, scores = language_id.judge(net, [make("abcd", 30), long, make("wxyz", 30)])
    assert labels == ["a", "w", "w"] and 0.9 < scores[1] < 0.99


# ---------------------------------------------------------------- token alignment

FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def gpt_bytes():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 0
    for b in range(256):
        table[chr(b) if b in keep else chr(256 + extra)] = b
        extra += b not in keep
    return table


def plain_tokens(text, libraries):
    """Ids and byte ranges of whole texts, straight from the libraries."""
    a, b = libraries
    if not text:
        return None
    letters = gpt_bytes()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) if i != 50256 else b"?" for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return None
    return ids_a, ids_b, np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()


def plain_alignments(texts, libraries):
    """Rows ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    held, count = [], collections.Counter()
    for t in texts:
        found = plain_tokens(t, libraries)
        if found is None:
            held.append(None)
            continue
        ids_a, ids_b, ends_a, ends_b = found
        both = sorted(set(ends_a) & set(ends_b))
        parts = []
        for lo, hi in zip([0, *both], both):
            one = [str(i) for i, e in zip(ids_a, ends_a) if lo < e <= hi]
            two = [str(i) for i, e in zip(ids_b, ends_b) if lo < e <= hi]
            parts.append(f"{','.join(one)}|{','.join(two)}")
        linked = []
        for i, (x, lo, hi) in enumerate(zip(ids_a, [0, *ends_a], ends_a)):
            linked += [(x, y) for y, lo2, hi2 in zip(ids_b, [0, *ends_b], ends_b) if lo < hi2 and lo2 < hi]
        count.update(linked)
        held.append((len(ids_a), len(ids_b), parts, linked))
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for h in held:
        if h is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, parts, linked = h
            digest = hashlib.sha256(";".join(parts).encode()).hexdigest()
            out.append((n_a, n_b, len(parts), len(linked), sum(count[p] == best[p[1]] for p in linked), sum(count[p] for p in linked), digest))
    return out


HARD = [
    "plain words and plain words",
    " leading space",
    "  two  spaces \t tab\nline \n\n lines  ",
    "naïve façade Über straße ñandú",
    "中文 字 😀 é ﬁ x² ½",
    "<|endoftext|> and </s> <s> <unk> stay text",
    "under▁score",
    "nbsp here ​ zero",
    "x",
    " ",
    "don't we'll 12345 3.14 a--b ...",
    "a" * 300,
    "word " * 500,
]


def test_alignment_matches_plain_version(spark, libraries):
    texts = [t for _, t, *_ in helpers.awkward() if len(t or "") < 1000] + HARD
    df = helpers.from_texts(spark, texts)
    for size in (token_alignment.BLOCK_BYTES, 40):
        got = token_alignment.align(df, token_alignment.Tokenizers(spark, *FILES), columns=["doc_id"], size=size).collect()
        assert [tuple(r)[1:] for r in sorted(got)] == plain_alignments(texts, libraries)


def test_alignment_of_given_documents(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts = {r["doc_id"]: r["text"] for r in docs}
    want = dict(zip(texts, plain_alignments([t if len(t or "") < 8000 else None for t in texts.values()], libraries)))
    short = spark.createDataFrame([(i, t if len(t or "") < 8000 else None) for i, t in texts.items()], "doc_id long, text string")
    got = token_alignment.align(short, token_alignment.Tokenizers(spark, *FILES)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want
    whole = queries.aligned_tokens(spark, SF).collect()
    assert {r["doc_id"] for r in whole} == set(texts)
    for r in whole:
        assert r["n_a"] == len(libraries[0].encode(" " + texts[r["doc_id"]], add_special_tokens=False).ids) or r["n_a"] == 0
        assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.data())
def test_groups_of_any_ends(lengths, data):
    """A random sequence against one in which some tokens are joined or cut: long equal stretches and all kinds of groups."""
    a = np.cumsum(lengths)
    kept = sorted(set(data.draw(st.lists(st.sampled_from(a.tolist()), max_size=80))) | {int(a[-1])} | set(a[5:60].tolist()))
    extra = data.draw(st.lists(st.integers(1, int(a[-1])), max_size=5))
    b = np.array(sorted({*kept, *extra}))
    first_a, first_b = token_alignment.groups(a, b)
    both = sorted(set(a.tolist()) & set(b.tolist()))
    starts = [0, *both[:-1]]
    assert first_a.tolist() == [int(np.searchsorted(a, s, side="right")) for s in starts]
    assert first_b.tolist() == [int(np.searchsorted(b, s, side="right")) for s in starts]
    link_a, link_b = token_alignment.links(a, b)
    assert len(link_a) == len(a) + len(b) - len(both)


def test_units_do_not_change_ids(libraries):
    a, b = libraries
    pair = token_alignment.Pair(open(FILES[0], encoding="utf-8").read(), open(FILES[1], "rb").read())
    assert pair.cut is not None
    for text in HARD[:6] + HARD[7:]:
        x, y = pair.encode(pair.units(text))
        assert [i for ids in x for i in ids] == a.encode(" " + text, add_special_tokens=False).ids
        assert [i for ids in y for i in ids] == b.encode(text)


def test_alignment_awkward_rows(spark):
    df = helpers.docs(spark, clashes=True).selectExpr("*", "7 as n_a", "'7' as Groups_sha256", "7 as block")
    got = token_alignment.align(df, token_alignment.Tokenizers(spark, *FILES))
    assert len({c.lower() for c in got.columns}) == len(got.columns) and {"size", "block"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == len(helpers.awkward())
    assert {r["n_a"] for r in rows if r["doc_id"] in (3, 4)} == {0} and all(r["groups_sha256"] == "" for r in rows if r["doc_id"] in (3, 4))
    assert token_alignment.align(df.limit(0), token_alignment.Tokenizers(spark, *FILES)).collect() == []
    blank = token_alignment.align(df.filter("text is null"), token_alignment.Tokenizers(spark, *FILES)).collect()
    assert [r["count_sum"] for r in blank] == [0, 0]
    assert json.loads(open(FILES[0], encoding="utf-8").read())["model"]["type"] == "BPE"


def made_texts(n):
    return [" ".join(f"w{i}x{j} and" for j in range(40)) for i in range(n)]


def test_alignment_rows_do_not_grow_with_their_block(spark):
    df = helpers.from_texts(spark, made_texts(400)).coalesce(1)
    rows = token_alignment.blocks(df, token_alignment.Tokenizers(spark, *FILES), "text", ["doc_id"]).collect()
    assert max(sum(len(v) for v in r if isinstance(v, bytes | bytearray | list)) for r in rows) < 8_000
    assert sorted(r["c0"] for r in rows if r["at"] is None) == sorted(r["doc_id"] for r in df.collect())


def test_alignment_parts_do_not_change_rows(spark, libraries, monkeypatch):
    """Units, documents and pairs that leave in many parts, and batches that end inside a block."""
    pair = token_alignment.Pair(open(FILES[0], encoding="utf-8").read(), open(FILES[1], "rb").read())
    texts = [None, "", *HARD, *made_texts(20), *HARD]

    def rows():
        parts = list(token_alignment._block(pair, texts))
        docs = [r for p in parts if "at" not in p for r in zip(*p.values())]
        return docs, [tuple(map(int, r)) for p in parts if "at" in p for r in zip(*p.values())]

    whole = rows()
    assert len(whole[0]) == len(texts)
    for name, n in (("_UNITS", 7), ("_PAIRS", 10), ("_COUNT_BYTES", 50)):
        monkeypatch.setattr(token_alignment, name, n)
    # Units of other parts, the same numbers of pairs.
    assert rows() == whole
    with_small = {"spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    before = {k: spark.conf.get(k) for k in with_small}
    try:
        for k, v in with_small.items():
            spark.conf.set(k, v)
        got = token_alignment.align(helpers.from_texts(spark, texts), token_alignment.Tokenizers(spark, *FILES), columns=["doc_id"], size=200).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [tuple(r)[1:] for r in sorted(got)] == plain_alignments(texts, libraries)


@given(st.lists(st.tuples(st.integers(0, 2**31 - 1), st.integers(1, 2**32 - 1)), unique_by=lambda x: x[0]))
def test_packed_counts_come_back(found):
    number, times = np.array(sorted(found), np.int64).reshape(-1, 2).T
    back = token_alignment.unpacked(token_alignment.packed(number, times))
    assert [b.tolist() for b in back] == [number.tolist(), times.tolist()]
