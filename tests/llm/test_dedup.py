import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import helpers
from tidemark.llm import exact_dedup, similar, simhash, wide_simhash


def test_exact_groups_awkward_rows(spark):
    df = helpers.docs(spark, clashes=True)
    got = exact_dedup.groups(df).collect()
    assert len(got) == df.count()
    by_hash = {}
    for r in got:
        by_hash.setdefault(r["text_sha256"], []).append(r)
    for group in by_hash.values():
        assert sum(r["kept"] for r in group) == 1
        assert {r["group_size"] for r in group} == {len(group)}
        ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
        assert {r["keep_id"] for r in group} == {min(ids) if ids else None}
    assert len(by_hash) == 7
    kept = exact_dedup.dedup(df)
    assert kept.columns == df.columns and kept.count() == len(by_hash)
    assert exact_dedup.groups(df.limit(0)).collect() == [] and exact_dedup.dedup(df.limit(0)).collect() == []


def test_exact_dedup_tells_colliding_texts_apart(spark, monkeypatch):
    # With a hash that is the same for every text only the comparison of bytes is left.
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("same"))
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.groups(helpers.from_texts(spark, ["a", "b", "a", "c"])).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3}


def near_texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 40, 400)))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base))
    return texts + ["", None, "one", "One", "one two", " \n"]


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_classes_match_brute_force(spark, hot):
    texts = near_texts()
    fps = [helpers.plain_fingerprint(t) for t in texts]
    want = helpers.plain_classes(fps)
    got = {r["doc_id"]: r for r in simhash.classes(helpers.from_texts(spark, texts), hot=hot).collect()}
    assert [got[i]["fp"] % 2**64 for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert len(set(want)) < len(texts) - 20


@pytest.mark.parametrize("hot", [simhash.HOT, 16])
def test_dense_fingerprints_match_brute_force(spark, hot):
    """Fingerprints drawn close together, on every border of the covering: all bit pairs and triples."""
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set(centres.tolist())
    for c in centres:
        for _ in range(60):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            fps.add(int(c) ^ sum(1 << int(b) for b in flips))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    roots = simhash.components(simhash.links(df, hot=hot))
    least = {}
    of = {r["node"] % 2**64: r["root"] for r in roots.collect()}
    got = []
    for i, f in enumerate(fps):
        key = of.get(f, f"own {f}")
        got.append(least.setdefault(key, i))
    assert got == helpers.plain_classes(fps)


def test_anchors_meet_for_every_near_pair(spark):
    """Two words that differ in at most one bit share an anchor, in both widths."""
    for bits in (16, 32):
        values = [0, (1 << bits) - 1, 0x5A5A5A5A % (1 << bits), 12345]
        pairs = [(v, v ^ flip) for v in values for flip in [0, *[1 << b for b in range(bits)]]]
        df = spark.createDataFrame(pairs, "a long, b long")
        shared = df.select(F.arrays_overlap(simhash.anchors(F.col("a"), bits), simhash.anchors(F.col("b"), bits)).alias("s"))
        assert all(r["s"] for r in shared.collect())


def test_components_of_a_chain_a_star_and_nothing(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    df = spark.createDataFrame(chain + star, "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(df).collect()}
    assert len(got) == 501
    assert len({got[i] for i in range(301)}) == 1 and len({got[i] for i in range(1000, 1200)}) == 1
    assert got[0] != got[1000]
    assert simhash.components(df.limit(0)) is None


def test_simhash_awkward_rows(spark):
    df = helpers.docs(spark, clashes=True)
    got = simhash.classes(df).collect()
    assert len(got) == df.count()
    assert {r["component_id"] for r in got if r["fp"] == 0} == {3}
    assert simhash.classes(df.limit(0)).collect() == []


def edited_texts():
    """Pairs on both sides of a five-word Jaccard similarity of 0.8, and one class of many edited copies."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for edits in [0, 1, 2, 3, 4, 5, 6, 8, 12] * 30:
        base = [rng.choice(vocabulary) for _ in range(rng.choice((60, 150, 400)))]
        texts.append(" ".join(base))
        for at in rng.sample(range(len(base)), edits):
            base[at] = rng.choice(vocabulary)
        texts.append(" ".join(base).upper())
    base = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(80):
        copy = list(base)
        copy[rng.randrange(200)] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    return texts + ["", None, "one", "One", "one two", " \n"]


def plain_similar(texts):
    """Links of all pairs with a five-word Jaccard similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    return {(i, j) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) if near(a, sets[j])}


def plain_roots(texts):
    root = list(range(len(texts)))
    for i, j in sorted(plain_similar(texts)):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    # Texts without words are one class.
    blank = [i for i, t in enumerate(texts) if not (t or "").split()]
    return [blank[0] if i in blank else r for i, r in enumerate(root)]


@pytest.mark.parametrize("hot", [similar.HOT, 5])
def test_similar_classes_match_brute_force(spark, hot):
    texts = edited_texts()
    want = plain_roots(texts)
    df = helpers.from_texts(spark, texts)
    got = {r["doc_id"]: r["component_id"] for r in similar.classes(df, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = {r["doc_id"] for r in similar.dedup(df, hot=hot).collect()}
    assert kept == set(want)
    # Fingerprints within three bits find far fewer of these pairs.
    pairs = [(i, j) for i, j in plain_similar(texts) if j < 540]
    fps = [helpers.plain_fingerprint(t) for t in texts]
    assert len(pairs) > 100 and sum((fps[i] ^ fps[j]).bit_count() <= simhash.BITS for i, j in pairs) < 0.7 * len(pairs)


def test_chance_to_share_an_anchor():
    """Pairs of sets at the threshold: the share that meets in a band is what theory says."""
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(600):
        pool = rng.integers(0, 1 << 63, 99, dtype=np.uint64)
        a, b = (np.frombuffer(similar.sketch(np.sort(pool[x])), "<u2").reshape(similar.BANDS, -1) for x in (np.arange(90), np.arange(10, 99)))
        met += bool((a == b).all(axis=1).any())
    assert met / 600 > 0.99


def test_rows_out_of_a_comparison_grow_with_the_group(spark):
    """One group of n edited copies: at most n - 1 links, not pairs."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    for n in (50, 200):
        texts = []
        for _ in range(n):
            copy = list(base)
            for at in rng.sample(range(300), 3):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        df = helpers.from_texts(spark, texts)
        nodes = similar.settle(similar.marked(df).selectExpr("doc_id as node", "doc_id as _least", "digest", "sketch", "size"))
        stars = similar.stars(similar.runs(nodes.df), nodes, similar.SIMILAR, similar.HOT)
        assert stars.count() <= 2 * n
        found = similar.links(df, nodes)
        assert found.count() < 2 * n
        assert {r["component_id"] for r in similar.classes(df).collect()} == {0}


def test_small_runs_and_chunks_change_nothing(spark):
    """Mixed runs dealt in blocks: every class of a common anchor is still found."""
    common_part = [f"c{i}" for i in range(150)]
    texts = []
    for k in range(24):
        own = [f"own{k}x{j}" for j in range(60)]
        for m in range(3):
            copy = list(own)
            copy[20 * m] = f"edit{k}x{m}"
            texts.append(" ".join(common_part + copy))
    want = plain_roots(texts)
    assert len(set(want)) == 24
    for hot in (similar.HOT, 2, 7):
        got = {r["doc_id"]: r["component_id"] for r in similar.classes(helpers.from_texts(spark, texts), hot=hot).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_rows_go_by_id_and_text(spark):
    rows = [(1, "a b c d e f g"), (7, "A B c d e f g"), (7, "quite another text that stands alone here"), (9, "a  b c d e f g"), (None, "a b c d e f g")]
    df = helpers.docs(spark, [(*r, "en", None, 1) for r in rows], clashes=True)
    kept = similar.dedup(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([rows[0], rows[2], rows[4]], key=repr)


def test_similar_awkward_rows(spark):
    df = helpers.docs(spark, clashes=True)
    got = similar.classes(df).collect()
    assert len(got) == df.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4, 5)} == {3}
    kept = similar.dedup(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 6, 7, 8, None}
    assert sorted(r["text"] for r in kept.collect() if r["doc_id"] == 7) == ["other text with the id of another row"]
    assert similar.classes(df.limit(0)).collect() == [] and similar.dedup(df.limit(0)).collect() == []


def test_shingle_hashes_are_the_shingles():
    text = "a b c d e f a b c d e x " * 3
    assert len(similar.shingle_hashes(text)) == len({tuple((text.split())[i : i + 5]) for i in range(len(text.split()) - 4)})
    assert len(similar.shingle_hashes("a b")) == 1 and len(similar.shingle_hashes(" \n")) == 0
    assert similar.shingle_hashes("A B") == similar.shingle_hashes("a  b") and similar.shingle_hashes("a b") != similar.shingle_hashes("b a")
    assert np.array_equal(similar.shingle_hashes("É b c d e"), similar.shingle_hashes("É B c d e"))


def test_covered_blocks_within_one_bit_share_an_anchor():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 23, 64)
    rows, found = wide_simhash.anchors(x)
    assert 15 < len(rows) / len(x) < 20
    for bit in range(23):
        other, near = wide_simhash.anchors(x ^ (1 << bit))
        for i in range(len(x)):
            shared = set(found[rows == i]) & set(near[other == i])
            assert shared and all((int(x[i]) ^ int(a)).bit_count() <= 2 for a in shared)


def test_chance_to_meet_in_a_covered_block():
    """Pairs of sets at the threshold: nearly all share an anchor, and no limit on differing bits parts them."""
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(600):
        pool = rng.integers(0, 1 << 63, 99, dtype=np.uint64)
        marks = [wide_simhash.words([wide_simhash.fingerprint(np.sort(pool[x]))]) for x in (np.arange(90), np.arange(10, 99))]
        a, b = (wide_simhash.blocks(m)[0] for m in marks)
        shared = any(len(np.intersect1d(wide_simhash.anchors(a[[i]])[1], wide_simhash.anchors(b[[i]])[1])) for i in range(wide_simhash.BLOCKS))
        met += bool(shared and wide_simhash.close(*marks, similar.SIMILAR)[0])
    assert met / 600 > 0.99


def test_near_stage_meets_at_simhash_anchors(spark, monkeypatch):
    """The stage of the pipeline equals brute force with its candidates from the covering alone: bands of minima are not asked."""
    monkeypatch.setattr(similar, "runs", None)
    texts = edited_texts()
    kept = corpus_pipeline.near(spark, helpers.from_texts(spark, texts), "")
    assert {r["doc_id"] for r in kept.collect()} == set(plain_roots(texts))


def test_large_and_small_anchors_see_the_same_nodes():
    """No near pair is lost: both ends leave the comparison under one key, whichever way the anchor is compared."""
    rng = np.random.default_rng(8)
    bases = rng.integers(0, 1 << 63, (30, 2), dtype=np.uint64)
    tags = np.repeat(bases, 4, axis=0)
    tags[:, 0] ^= rng.integers(0, 1 << 20, len(tags), dtype=np.uint64)
    tags[:, 1] ^= rng.integers(0, 1 << 20, len(tags), dtype=np.uint64)
    n, node = len(tags), np.arange(len(tags)) + 1000
    near = {(i, j) for i in range(n) for j in range(i + 1, n) if wide_simhash.close(tags[i], tags[j], similar.SIMILAR)}
    assert n < len(near) < 4 * n
    key = np.zeros(n, dtype=np.int32)
    for got in (wide_simhash._starred(key, node, tags, 0.8), wide_simhash._paired(key, node, tags, np.array([0]), np.array([n]), 0.8)):
        keys = dict(zip(got[1].tolist(), got[0].tolist()))
        assert set(keys) == {int(node[i]) for pair in near for i in pair}
        assert all(keys[1000 + i] == keys[1000 + j] for i, j in near)
        assert all(p <= i and (p == i or (p - 1000, i - 1000) in near) for i, p in zip(got[1].tolist(), got[2].tolist()))


def test_rows_that_meet_grow_with_the_group(spark):
    """Copies of one text with small edits: rows per anchor, not pairs."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    for n in (200,):
        texts = []
        for i in range(n):
            copy = list(base)
            copy[rng.randrange(300)] = f"x{i}"
            texts.append(" ".join(copy))
        nodes = similar.settle(similar.marked(helpers.from_texts(spark, texts), method=similar.COVERED).selectExpr("doc_id as node", "sketch"))
        assert wide_simhash.met(nodes.df, similar.SIMILAR).rows <= 37 * wide_simhash.BLOCKS * n


def test_components_that_meet_are_compared_once(spark):
    """Copies just below the threshold share many anchors: a node is one row of the comparison, not one per anchor."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    n, texts = 150, []
    for i in range(n):
        copy = list(base)
        for k, at in enumerate(rng.sample(range(300), 4)):
            copy[at] = f"x{i}y{k}"
        texts.append(" ".join(copy))
    df = helpers.from_texts(spark, texts)
    nodes = similar.settle(similar.marked(df, method=similar.COVERED).selectExpr("doc_id as node", "doc_id as _least", "digest", "sketch", "size"))
    met = wide_simhash.met(nodes.df, similar.SIMILAR)
    assert met.rows > 5 * n
    left = similar.mixed_runs(met, nodes, None, similar.SIMILAR, similar.HOT, similar.COVERED)
    assert left.rows <= n and len({r["group"] for r in left.df.select("group").distinct().collect()}) == 1
    for hot in (similar.HOT, 6):
        got = {r["doc_id"]: r["component_id"] for r in similar.classes(df, hot=hot, method=similar.COVERED).collect()}
        assert [got[i] for i in range(n)] == plain_roots(texts)


def test_large_chains_are_left_to_their_runs(spark):
    """A cluster above ``hot`` whose runs are small keeps its runs; its pairs are still all together in one of them."""
    rows = [(100 + i, node, i, i) for i in range(40) for node in (i, i + 1)]
    met = similar.settle(spark.createDataFrame(rows, "key long, node long, pivot long, head long"))
    nodes = similar.settle(spark.range(50).withColumnRenamed("id", "node"))
    for hot, groups in ((41, 1), (40, 40)):
        got = {}
        for r in similar.clusters(met, nodes, None, hot).collect():
            got.setdefault(r["key"], set()).add(r["node"])
        assert len(got) == groups and all(any({i, i + 1} <= g for g in got.values()) for i in range(40))
