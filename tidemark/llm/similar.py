"""Near copies of whole texts: five-word shingle sets with a Jaccard similarity of 0.8 or more.

Where texts meet is a ``Method``. ``COVERED``, which the pipeline uses, is SimHash by anchor-point covering: wide fingerprints
in covered blocks (``wide_simhash``). ``MINIMA`` takes the bands of a minima sketch as anchors: ``BANDS`` groups of ``ROWS``
minima of the shingle hashes, so two texts at the threshold share an anchor with probability 0.998.

Equal shingle sets are one node. Texts of one anchor form a run, and every pair of a run ends up compared, in two steps:

1. every node goes to the first node (pivot) of its runs whose sketch is close, and each such star is compared;
2. components that still meet in a run are put into clusters, and nodes with a close node of another component of their
   cluster are compared: a node is one row, however many runs it is in.

A comparison takes whole sets of 64-bit shingle hashes, inside a task, and emits a spanning forest: at most one row
a node. Stars and clusters above ``HOT`` nodes are dealt over chunks; only their pivot, or the nodes outside their
largest component, are copied. Such a cluster is compared run by run where its runs hold fewer pairs than it does as a whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, wide_simhash
from tidemark.llm.simhash import components
from tidemark.session import Sized, settle

WORDS = 5
SIMILAR = 0.8
BANDS = 20
ROWS = 6
SEED = 42
# Nodes that are compared with one another in one task.
HOT = 8192
# Shingles whose minima are taken at a time, and words whose hashes a worker remembers.
_CHUNK = 4096
_REMEMBERED = 1 << 16
_DRAWN = np.random.default_rng(SEED).integers(1, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hashes of words, computed at their first use."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < _REMEMBERED:
            self[word] = value
        return value


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    known = common.kept("word hashes", str(SEED), _WordHashes)
    each = np.fromiter(map(known.__getitem__, w), dtype=np.uint64, count=len(w))
    size = min(words, len(w))
    z = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        z = (z ^ each[i : len(w) - size + 1 + i]) * _ODD
        z ^= z >> np.uint64(29)
    return np.unique((z ^ (z >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9))


def sketch(hashes: np.ndarray) -> bytes | None:
    """The upper 16 bits of the ``BANDS * ROWS`` minima; none for an empty set."""
    if not len(hashes):
        return None
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for begin in range(0, len(hashes), _CHUNK):
        np.minimum(least, ((hashes[begin : begin + _CHUNK, None] ^ _DRAWN[0]) * _DRAWN[1]).min(axis=0), out=least)
    # Minima are small numbers: mix them before they are cut.
    return ((least * _ODD) >> np.uint64(48)).astype("<u2").tobytes()


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.md5(hashes.tobytes()).digest()


def anchors() -> Column:
    """One key per band of ``sketch``."""
    width = 2 * ROWS
    return F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 1 + width * i, width)) for i in range(BANDS)])


def _close(similarity: float) -> int:
    """How many minima a pair at the threshold shares at least: the expectation less four and a half deviations."""
    n = BANDS * ROWS
    return math.floor(n * similarity - 4.5 * math.sqrt(n * similarity * (1 - similarity)))


def _whole_groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of frames that come sorted by ``by``, one at a time."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        codes = frame[by].ne(frame[by].shift()).any(axis=1).to_numpy()
        codes[0] = not held or bool((frame[by].iloc[0] != held[-1][by].iloc[-1]).any())
        starts = np.flatnonzero(codes)
        cuts = [0, *(starts[starts > 0]), len(frame)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if (k or codes[0]) and held:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held.append(frame.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def _sketches(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype="<u2").reshape(len(values), BANDS * ROWS)


def _agree(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    return (x == y).sum(axis=-1) >= _close(similarity)


def compared(rows: DataFrame, similarity: float = SIMILAR, method: Method | None = None) -> DataFrame:
    """Links ``a, b`` per (group, chunk) of ``rows`` (group, chunk, node, label, sketch, hashes).

    Nodes of one label count as linked. Each pair of different labels is compared unless links found before already
    connect it, so the links are a spanning forest of the similar pairs.
    """
    share, (unpack, close) = similarity, (method or MINIMA)[1:3]

    def forest(f: pd.DataFrame) -> tuple[list[int], list[int]]:
        node, sets = f["node"].to_numpy(np.int64), [np.frombuffer(h, np.uint64) for h in f["hashes"]]
        marks, sizes = unpack(f["sketch"].tolist()), np.array([len(s) for s in sets])
        root = np.unique(f["label"].to_numpy(np.int64), return_inverse=True)[1]
        a, b = [], []
        for i in range(len(node) - 1):
            other = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
            if not len(other):
                continue
            fits = np.minimum(sizes[other], sizes[i]) >= share * np.maximum(sizes[other], sizes[i])
            other = other[fits]
            other = other[close(marks[other], marks[i], share)]
            for j in other.tolist():
                if root[j] == root[i]:
                    continue
                at = np.searchsorted(sets[i], sets[j])
                at[at == sizes[i]] = 0
                both = int((sets[i][at] == sets[j]).sum())
                if both >= share * (sizes[i] + sizes[j] - both):
                    root[root == root[j]] = root[i]
                    a.append(int(node[i]))
                    b.append(int(node[j]))
        return a, b

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_groups(frames, ["group", "chunk"]):
            a, b = forest(f)
            if a:
                yield pd.DataFrame({"a": a, "b": b})

    common.small_batches(rows.sparkSession)
    placed = rows.repartition("group", "chunk").sortWithinPartitions("group", "chunk", "node")
    return placed.mapInPandas(run, "a long, b long")


def runs(nodes: DataFrame) -> Sized:
    """Rows ``key, node, pivot, head, n`` of all anchors with two nodes or more; the pivot is the first node, and the head as well."""
    entries = nodes.filter("sketch IS NOT NULL").select("node", F.explode(anchors()).alias("key"))
    heads = settle(entries.groupBy("key").agg(F.min("node").alias("pivot"), F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return settle(common.join_checked(entries, heads, ["key"]))


class Method(NamedTuple):
    """How similar sets meet: the mark of a set, marks as an array, which marks may belong to similar sets, and
    from nodes (node, sketch) the rows ``key, node, pivot, head`` of those that meet."""

    mark: Callable[[np.ndarray], bytes | None]
    unpack: Callable[[list[bytes]], np.ndarray]
    close: Callable[[np.ndarray, np.ndarray, float], np.ndarray]
    meet: Callable[[DataFrame, float], Sized]


MINIMA = Method(sketch, _sketches, _agree, lambda nodes, similarity: runs(nodes))
COVERED = Method(wide_simhash.fingerprint, wide_simhash.words, wide_simhash.close, wide_simhash.met)


def _with(rows: DataFrame, nodes: Sized, names: dict[str, str], on: str = "node") -> DataFrame:
    """``rows`` with columns of ``nodes`` under new names, found by node number in column ``on``."""
    side = nodes.df.select(F.col("node").alias(on), *[F.col(old).alias(new) for old, new in names.items()])
    return common.join_checked(rows, Sized(side, nodes.rows, nodes.bytes), [on])


def stars(met: Sized, nodes: Sized, similarity: float, hot: int, method: Method = MINIMA) -> DataFrame:
    """Rows ``group, chunk, node, label``: every node with the first pivot that is close to it, and the pivots themselves."""
    unpack, close = method[1:3]
    pairs = met.df.filter("node <> pivot").select("node", "pivot").distinct()
    pairs = _with(_with(pairs, nodes, {"sketch": "_x", "size": "_n"}), nodes, {"sketch": "_y", "size": "_m"}, "pivot")
    pairs = pairs.filter(F.least("_n", "_m") >= similarity * F.greatest("_n", "_m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (unpack(batch.column(i).to_pylist()) for i in (2, 3))
            yield batch.select(["node", "pivot"]).filter(pa.array(close(x, y, similarity)))

    found = pairs.select("node", "pivot", "_x", "_y").mapInArrow(run, "node long, pivot long")
    chosen = settle(found.groupBy("node").agg(F.min("pivot").alias("group"))).df
    sizes = settle(chosen.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("chunks")))
    members = common.join_checked(chosen, sizes, ["group"]).select("group", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), "node")
    heads = sizes.df.select("group", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("group").alias("node"))
    return members.unionByName(heads).withColumn("label", F.col("node"))


def _shares(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group of ``rows`` (by, label) the largest component ``major``, its nodes ``_m``, all nodes ``_n``, all components ``_k``."""
    parts = rows.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_c"))
    return parts.groupBy(*by).agg(F.max_by("label", F.struct("_c", "label")).alias("major"), F.max("_c").alias("_m"), F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))


def clusters(met: Sized, nodes: Sized, roots: Sized | None, hot: int) -> DataFrame | None:
    """Rows ``key, node, label`` of the components that meet others in a run: those connected over runs share a key.

    Two nodes of one run are in one cluster, so no pair of a run is lost. A cluster above ``hot`` nodes may be a long
    chain of small runs: it is left to its runs where these hold fewer pairs than the whole. None if no run is mixed.
    """

    def labelled(rows: DataFrame, on: str = "node", to: str = "label") -> DataFrame:
        if roots is None:
            return rows.withColumn(to, F.col(on))
        side = Sized(roots.df.select(F.col("node").alias(on), F.col("root").alias("_root")), roots.rows, roots.bytes)
        return common.join_checked(rows, side, [on], "left").withColumn(to, F.coalesce("_root", on)).drop("_root")

    pairs = met.df.filter("node <> head").select("node", "head").distinct()
    pairs = labelled(labelled(pairs, "node", "a"), "head", "b").filter("a <> b")
    found = components(settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()).df)
    if found is None:
        return None
    found = settle(found.select(F.col("node").alias("label"), F.col("root").alias("key")))
    whole = settle(common.join_checked(labelled(nodes.df.select("node")), found, ["label"]).select("key", "node", "label"))
    sizes = settle(_shares(whole.df, ["key"]), large=F.count_if(F.col("_n") > hot))
    if not sizes.seen["large"]:
        return whole.df
    held = F.col("_n") * (F.col("_n") - F.col("_m"))
    large = settle(sizes.df.filter(F.col("_n") > hot).select("key", held.alias("_pairs")))
    own = settle(common.join_checked(whole.df, large, ["key"]).withColumnRenamed("key", "cluster"))
    by_run = settle(common.join_checked(met.df.select("key", "node"), own, ["node"]))
    cheaper = _shares(by_run.df, ["cluster", "key"]).groupBy("cluster").agg(F.sum(held).alias("_runs"))
    cheaper = common.join_checked(cheaper, Sized(large.df.withColumnRenamed("key", "cluster"), large.rows, large.bytes), ["cluster"])
    apart = settle(cheaper.filter("_runs < _pairs").select("cluster"))
    kept = common.join_checked(whole.df, Sized(apart.df.withColumnRenamed("cluster", "key"), apart.rows, apart.bytes), ["key"], "left_anti")
    return kept.unionByName(common.join_checked(by_run.df, apart, ["cluster"], "left_semi").select("key", "node", "label"))


def mixed_runs(met: Sized, nodes: Sized, roots: Sized | None, similarity: float, hot: int, method: Method = MINIMA) -> Sized | None:
    """Rows ``group, chunk, node, label`` of clusters of several components: the nodes close to one of another component.

    Nodes outside a cluster's largest component ask, in blocks of ``hot``; all its nodes answer, in blocks as well.
    None if no run holds several components.
    """
    unpack, close = method[1:3]
    labelled = clusters(met, nodes, roots, hot)
    if labelled is None:
        return None
    largest = _shares(labelled, ["key"])
    blocks = lambda c: F.ceil(c / hot).cast("int")
    mixed = settle(largest.filter("_k > 1").select("key", "major", blocks(F.col("_n")).alias("all"), blocks(F.col("_n") - F.col("_m")).alias("asking")))
    rows = common.join_checked(labelled, mixed, ["key"])
    place = lambda c: F.pmod(F.xxhash64("node"), c).cast("int")
    every = lambda c: F.sequence(F.lit(0), c - 1)
    answers = F.transform(every(F.col("asking")), lambda i: i * F.col("all") + place(F.col("all")))
    asks = F.transform(every(F.col("all")), lambda j: place(F.col("asking")) * F.col("all") + j)
    chunks = F.when(F.col("label") == F.col("major"), answers).otherwise(F.array_union(answers, asks))
    dealt = rows.select(F.col("key").alias("group"), F.explode(chunks).alias("chunk"), "node", "label")
    dealt = _with(dealt, nodes, {"sketch": "sketch", "size": "size"})
    share = similarity

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_groups(frames, ["group", "chunk"]):
            marks, label, size = unpack(f["sketch"].tolist()), f["label"].to_numpy(np.int64), f["size"].to_numpy()
            wanted = np.zeros(len(f), dtype=bool)
            for i in range(len(f) - 1):
                other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
                other = other[np.minimum(size[other], size[i]) >= share * np.maximum(size[other], size[i])]
                other = other[close(marks[other], marks[i], share)]
                if len(other):
                    wanted[i] = wanted[other] = True
            if wanted.any():
                yield f.loc[wanted, ["group", "chunk", "node", "label"]]

    placed = dealt.repartition("group", "chunk").sortWithinPartitions("group", "chunk", "node")
    return settle(placed.mapInPandas(run, "group long, chunk int, node long, label long"))


def _sets(docs: DataFrame, asked: DataFrame, nodes: Sized, text: str, method: Method) -> Sized:
    """``node, hashes, sketch`` of the ``asked`` nodes, made again from the texts with their least ids."""
    wanted = settle(common.join_checked(nodes.df.select("node", "digest", "_least"), settle(asked.select("node").distinct()), ["node"]))
    ids = settle(wanted.df.select(common.null_safe(F.col("_least")).alias("_id")).distinct())
    rows = docs.select(common.null_safe(F.col("doc_id")).alias("_id"), F.col(text).alias("_of"))
    rows = common.join_checked(rows, ids, ["_id"], "left_semi")

    mark = method.mark

    def make(texts: list[str | None]) -> list[pa.Array]:
        sets = [shingle_hashes(t) for t in texts]
        packed = [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(list(map(mark, sets)), pa.binary())]
        return [pa.array(list(map(digest, sets)), pa.binary()), *packed]

    made = common.map_texts(rows, "_of", [], make, "digest binary, hashes binary, sketch binary")
    found = common.join_checked(made, Sized(wanted.df.select("node", "digest"), wanted.rows, wanted.bytes), ["digest"])
    return settle(found.groupBy("node").agg(F.first("hashes").alias("hashes"), F.first("sketch").alias("sketch")))


def _verified(groups: DataFrame, docs: DataFrame, nodes: Sized, text: str, similarity: float, method: Method) -> Sized:
    sets = _sets(docs, groups, nodes, text, method)
    return settle(compared(_with(groups, sets, {"hashes": "hashes", "sketch": "sketch"}), similarity, method).distinct())


def links(docs: DataFrame, nodes: Sized, text: str = "text", similarity: float = SIMILAR, hot: int = HOT, method: Method = MINIMA) -> DataFrame:
    """Links ``a, b`` of ``nodes`` (node, digest, sketch, size, _least) that connect all similar pairs which share an anchor."""
    met = method.meet(nodes.df, similarity)
    first = _verified(settle(stars(met, nodes, similarity, hot, method)).df, docs, nodes, text, similarity, method)
    found = components(first.df)
    left = mixed_runs(met, nodes, None if found is None else settle(found), similarity, hot, method)
    if left is None or not left.rows:
        return first.df
    return first.df.unionByName(_verified(left.df, docs, nodes, text, similarity, method).df)


def marked(docs: DataFrame, text: str = "text", method: Method = MINIMA) -> DataFrame:
    """``doc_id, digest, sketch, size`` of every row: the hash of its shingle set, its mark, its number of shingles; written once."""
    mark = method.mark

    def make(texts: list[str | None]) -> list[pa.Array]:
        sets = [shingle_hashes(t) for t in texts]
        marks = [pa.array(list(map(digest, sets)), pa.binary()), pa.array(list(map(mark, sets)), pa.binary())]
        return [*marks, pa.array(list(map(len, sets)), pa.int64())]

    return settle(common.map_texts(docs, text, ["doc_id"], make, "digest binary, sketch binary, size long")).df


def _classes(docs: DataFrame, text: str, similarity: float, hot: int, method: Method) -> DataFrame:
    """One row per document: ``doc_id, digest, component_id``."""
    rows = marked(docs, text, method)
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("_least"), F.first("sketch").alias("sketch"), F.first("size").alias("size"))
    nodes = settle(least.withColumn("node", F.monotonically_increasing_id()))
    roots = components(links(docs, nodes, text, similarity, hot, method))
    if roots is None:
        named = nodes.df.select("digest", F.col("_least").alias("component_id"))
    else:
        rooted = common.join_checked(nodes.df.select("node", "digest", "_least"), settle(roots), ["node"], "left")
        rooted = settle(rooted.select("digest", F.coalesce("root", "node").alias("root"), "_least")).df
        first = settle(rooted.groupBy("root").agg(F.min("_least").alias("component_id")))
        named = common.join_checked(rooted, first, ["root"]).select("digest", "component_id")
    return common.join_checked(rows.select("doc_id", "digest"), settle(named), ["digest"])


def classes(docs: DataFrame, text: str = "text", similarity: float = SIMILAR, hot: int = HOT, method: Method = MINIMA) -> DataFrame:
    """One row per document: ``doc_id, component_id`` (the smallest id reachable over pairs of at least ``similarity``).

    Texts with equal shingle sets, and all texts without words, are one class. Null ids are passed over for
    ``component_id``, which is null where a class has no id. Repeated rows give repeated rows; an empty table gives an empty result.
    """
    return _classes(docs, text, similarity, hot, method).select("doc_id", "component_id")


def dedup(docs: DataFrame, text: str = "text", similarity: float = SIMILAR, hot: int = HOT, method: Method = MINIMA) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: of each class of similar texts the row with the smallest id.

    Rows are removed by id and text: a row whose id also belongs to a text of another class goes only with its own
    class. Rows without id and classes without any id stay whole; of a repeated id every row in the kept class stays.
    """
    found = settle(_classes(docs, text, similarity, hot, method).groupBy("doc_id", "digest").agg(F.first("component_id").alias("component_id"))).df
    gone = found.filter("doc_id > component_id")
    both = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("doc_id") > F.col("component_id")).alias("_gone")).filter("_gone > 0")
    plain = settle(both.filter("_gone = _all").select("doc_id"))
    shared = settle(both.filter("_gone < _all").select("doc_id"))
    stays = common.join_checked(docs, plain, ["doc_id"], "left_anti").select(*docs.columns)
    if not shared.rows:
        return stays
    # Some ids carry texts of several classes: their rows are told apart by the hash of the shingle set.
    clear = common.join_checked(stays, shared, ["doc_id"], "left_anti").select(*docs.columns)
    asked = common.join_checked(stays.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.col(f"`{text}`").alias("_of")), shared, ["doc_id"], "left_semi")
    told = common.map_texts(asked, "_of", ["doc_id", "_all"], lambda texts: [pa.array([digest(shingle_hashes(t)) for t in texts], pa.binary())], "digest binary")
    kept = common.join_checked(told, settle(gone.select("doc_id", "digest")), ["doc_id", "digest"], "left_anti")
    return clear.unionByName(kept.select("_all.*"))
