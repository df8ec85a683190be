import collections
import math
import zlib

import pytest

from tests.conftest import SF
from tests.llm import helpers
from tidemark.llm import mixing, queries, sharding


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight; stop at the cap; share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * left / w > cap * sizes[s]]
        if not above:
            return fixed | {s: weight[s] * left / w for s in free}
        fixed |= {s: cap * sizes[s] for s in above}


def test_targets_stop_at_cap_and_share_the_excess(spark):
    sizes = {"a": 10, "b": 500, "c": 40, "d": 3, "e": 0, None: 900}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_copies_follow_targets_and_repeat_exactly(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), "en", f"s{i % 4 if i % 3 else 0}", 0) for i in range(3000)]
    df = helpers.docs(spark, rows)
    first = mixing.with_copies(df, columns=[]).collect()
    again = mixing.with_copies(df.repartition(5), columns=[]).collect()
    assert {(r["doc_id"], r["taken"]) for r in first} == {(r["doc_id"], r["taken"]) for r in again}
    taken, target = collections.Counter(), {}
    for r in first:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 2 * 50 for s in target)
    mixed = collections.Counter(r["doc_id"] for r in mixing.mix(df).collect())
    assert mixed == {r["doc_id"]: r["copies"] for r in first if r["copies"]}


def test_mixing_awkward_rows(spark):
    df = helpers.docs(spark, clashes=True)
    got = mixing.with_copies(df).collect()
    assert len(got) == df.count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in got if not (r["text"] or "").strip())
    assert mixing.mix(df).columns == df.columns
    empty = df.limit(0)
    assert mixing.with_copies(empty).collect() == [] and mixing.mix(empty).collect() == []


def test_longest_first_is_least_loaded():
    chosen = sharding.longest_first([(7, "a"), (5, "b"), (4, "c"), (4, "d"), (3, "e")], 2)
    loads = collections.Counter()
    for size, key in [(7, "a"), (5, "b"), (4, "c"), (4, "d"), (3, "e")]:
        loads[chosen[key]] += size
    assert sorted(loads.values()) == [11, 12]


def test_shards_are_even_gapless_and_keep_groups(spark):
    texts = [f"{'t' * (i * 37 % 400)} {i % 1500}" for i in range(4000)] + ["copy"] * 500
    got = sharding.shard(helpers.from_texts(spark, texts), shards=8).collect()
    loads, slots, of_text = collections.Counter(), collections.defaultdict(list), {}
    for r in got:
        assert r["size"] == len(r["text"].encode()) + 8
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert of_text.setdefault(r["text"], r["shard"]) == r["shard"]
    assert len(got) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) - min(loads.values()) <= 2000


def test_sharding_awkward_rows(spark):
    df = helpers.docs(spark, clashes=True)
    got = sharding.shard(df, shards=3).collect()
    assert len(got) == df.count()
    blank = {r["shard"] for r in got if not r["text"]}
    assert len(blank) == 1 and {r["text_crc32"] for r in got if not r["text"]} == {0}
    assert sharding.shard(df.limit(0)).collect() == []


@pytest.mark.parametrize("groups", [0, 1, 5])
def test_longest_first_with_few_groups(groups):
    assert len(sharding.longest_first([(1, i) for i in range(groups)], 24)) == groups


def test_bundles_on_the_driver_are_bounded():
    for partitions in (1, 8, 200, 8_333, 8_334, 100_000, 10_000_000):
        for shards in (1, 24, 1000):
            parts, bundles = sharding._sizes(partitions, shards)
            assert 1 <= parts <= partitions and bundles >= shards and parts * bundles <= sharding.MOST_BUNDLES


def test_sharding_query_against_plain_rows(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op3_sharded_documents"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    place, loads, slots, groups = {}, collections.Counter(), collections.defaultdict(list), collections.Counter()
    for r in got:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        assert place.setdefault(data, r["shard"]) == r["shard"] and 0 <= r["shard"] < 24
        loads[r["shard"]] += r["size"]
        groups[data] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(loads.values()) - min(loads.values()) <= max(groups.values())
