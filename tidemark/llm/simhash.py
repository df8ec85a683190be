"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits. Of two that differ in at most 3 bits, one 32-bit half differs in at most
one. For that half the anchors are the words of a covering code: a [31,26] Hamming code with one free
bit, covering radius 1. Every fingerprint is replicated to all anchors within covering radius plus
threshold (1 + 1 = 2): the anchor next to one fingerprint then also holds its partner. Fingerprints are
compared per anchor, and an anchor emits a spanning forest of its links, never all pairs.

An anchor with more than ``HOT`` fingerprints is split exactly: by anchors of a [15,11] code with a free
bit on the quarters of the other half (one of which differs in at most one bit), and what is still hot
by pairs of blocks. Equal fingerprints are collapsed first, so copies of a text cost one entry.

Copies of whole texts beyond three bits are found in ``similar``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.session import Sized, settle

WORDS = 3
BITS = 3
SEED = 42
# Fingerprints that one task compares with one another at a time.
HOT = 8192
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; no words: 0."""
    if not text:
        return 0
    w = text.encode("utf-8").lower().split()
    if not w:
        return 0
    shingles = [w] if len(w) < words else zip(*[w[i:] for i in range(words)])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for begin in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[begin : begin + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a long), one row per document, written once."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        found = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64)
        return [pa.array(found.view(np.int64))]

    return settle(common.map_texts(docs, text, ["doc_id"], make, "fp long")).df


def _parity(value: Column, mask: int) -> Column:
    return F.bit_count(value.bitwiseAND(F.lit(mask).cast("long"))) % 2


def _nearby(bits: int) -> list[list[int]]:
    """Per syndrome, what to flip in a word of ``bits`` bits to reach every anchor within distance 2.

    Positions 1 .. bits-1 carry a perfect Hamming code, the last bit is free.
    """
    n, free = bits - 1, 1 << (bits - 1)
    flips = []
    for s in range(bits):
        nearest = (1 << (s - 1)) if s else 0
        masks = [nearest, nearest | free]
        if s:
            masks += [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, n + 1) if i < i ^ s]
        flips.append(masks)
    return flips


def anchors(part: Column, bits: int) -> Column:
    """Array of all anchors within distance 2 of the low ``bits`` (16 or 32) bits in ``part``."""
    syndrome = F.lit(0)
    for j in range(bits.bit_length() - 1):
        mask = sum(1 << (i - 1) for i in range(1, bits) if i >> j & 1)
        syndrome = syndrome + _parity(part, mask) * (1 << j)
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in masks]) for masks in _nearby(bits)])
    return F.transform(F.element_at(table, (syndrome + 1).cast("int")), lambda m: part.bitwiseXOR(m))


def _numbered(keys: Column, base: int) -> Column:
    return F.transform(keys, lambda k: k + F.lit(base).cast("long"))


def _low(value: Column, bits: int) -> Column:
    return value.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _forest(f: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within ``f``: breadth first, each reached fingerprint leaves the rest."""
    left, right = [], []
    rest = f
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                reached = rest[near]
                left.append(np.full(len(reached), x))
                right.append(reached)
                queue.extend(reached)
                rest = rest[~near]
    none = np.empty(0, dtype=f.dtype)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _compare(entries: DataFrame, bits: int, hot: int) -> Sized:
    """Links per (k, g) of ``entries`` (k, g, fp): rows ``a, b``; runs above ``hot`` come back as rows with ``k``.

    ``hot`` 0 compares runs of any length. Reads sorted partitions batch by batch and holds one run.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(k, g, f):
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])])
            ends = np.r_[starts[1:], len(k)]
            two = starts[ends - starts == 2]
            near = np.bitwise_count(f[two] ^ f[two + 1]) <= bits
            a, b = [f[two[near]]], [f[two[near] + 1]]
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                x, y = _forest(f[s:e], bits)
                a.append(x)
                b.append(y)
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates().assign(k=None)

        def hot_rows(f, key):
            f = f.view(np.int64)
            return pd.DataFrame({"a": f, "b": f, "k": np.full(len(f), key, dtype=np.int64)})

        def typed(frame):
            return frame.astype({"k": "Int64"})

        k = g = np.empty(0, dtype=np.int64)
        f = np.empty(0, dtype=np.uint64)
        open_hot: tuple[int, int] | None = None
        for frame in frames:
            k = np.concatenate([k, frame["k"].to_numpy(np.int64)])
            g = np.concatenate([g, frame["g"].to_numpy(np.int64)])
            f = np.concatenate([f, frame["fp"].to_numpy(np.int64).view(np.uint64)])
            while len(k):
                same = (k == k[0]) & (g == g[0])
                first_run = int(same.argmin()) if not same.all() else len(k)
                if open_hot == (k[0], g[0]) or (hot and first_run > hot):
                    open_hot = (k[0], g[0])
                    yield typed(hot_rows(f[:first_run], k[0]))
                    k, g, f = k[first_run:], g[first_run:], f[first_run:]
                    continue
                starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])])
                lengths = np.diff(np.r_[starts, len(k)])
                big = np.flatnonzero(lengths > hot) if hot else np.empty(0, dtype=int)
                cut = int(starts[big[0]]) if len(big) else int(starts[-1])
                if cut:
                    found = links(k[:cut], g[:cut], f[:cut])
                    if len(found):
                        yield typed(found)
                    k, g, f = k[cut:], g[cut:], f[cut:]
                if not len(big):
                    break
        if len(k):
            found = links(k, g, f)
            if len(found):
                yield typed(found)

    sorted_entries = entries.repartition("k", "g").sortWithinPartitions("k", "g")
    return settle(
        sorted_entries.mapInPandas(run, "a long, b long, k long"), hot=F.count_if(F.col("k").isNotNull())
    )


def links(distinct: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Links ``a < b`` that connect all fingerprints (distinct column ``fp``) within ``bits`` of one another.

    ``bits`` may be 0 to 3. Every pair within the threshold is connected by the result.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the anchors cover thresholds up to 3")
    halves = [_low(F.col("fp"), 32), F.shiftrightunsigned("fp", 32)]
    keys = [_numbered(anchors(h, 32), i << 32) for i, h in enumerate(halves)]
    entries = distinct.select(F.explode(F.concat(*keys)).alias("k"), F.lit(0).cast("long").alias("g"), "fp")
    first = _compare(entries, bits, hot)
    found = [first.df.filter("k IS NULL")]
    if first.seen["hot"]:
        # k names the half that was matched; the anchors of the next level are in the other one.
        again = first.df.filter("k IS NOT NULL").select("k", F.col("a").alias("fp"))
        other = F.when(F.col("k") < (1 << 32), F.shiftrightunsigned("fp", 32)).otherwise(_low(F.col("fp"), 32))
        quarters = [_low(other, 16), F.shiftrightunsigned(other, 16)]
        finer = [_numbered(anchors(q, 16), i << 16) for i, q in enumerate(quarters)]
        key = (F.shiftleft("k", 17) + F.col("_fine")).alias("k")
        entries = again.withColumn("_fine", F.explode(F.concat(*finer))).select(key, F.lit(0).cast("long").alias("g"), "fp")
        second = _compare(entries, bits, hot)
        found.append(second.df.filter("k IS NULL"))
        if second.seen["hot"]:
            again = second.df.filter("k IS NOT NULL").select("k", F.col("a").alias("fp"))
            blocks = settle(again.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / max(1, hot // 2)).alias("_blocks")))
            placed = common.join_checked(again, blocks, ["k"]).withColumn("_at", F.pmod(F.xxhash64("fp"), "_blocks"))
            other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other")
            pairs = placed.select("k", "fp", "_at", other)
            g = F.least("_at", "_other") * (1 << 30) + F.greatest("_at", "_other")
            found.append(_compare(pairs.select("k", g.alias("g"), "fp"), bits, 0).df)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("a", "b").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame | None:
    """``node, root`` for the nodes of ``edges`` (a, b): contraction round by round, hooking to a neighbour.

    Each round every node moves to its first neighbour in an order that changes from round to
    round, which shrinks chains by a constant factor; the mappings are composed at the end. Nothing
    but counts reaches the driver. None if there is no edge.
    """
    current = settle(edges.select("a", "b"))
    moves: list[Sized] = []
    while current.rows:
        rank = (lambda c: c) if not moves else (lambda c, r=len(moves): F.xxhash64(c, F.lit(r)))
        both = current.df.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(
            current.df.select(F.col("b").alias("x"), F.col("a").alias("y"))
        )
        first = F.min(F.struct(rank(F.col("y")).alias("r"), F.col("y").alias("p"))).alias("m")
        own = F.struct(rank(F.col("x")).alias("r"), F.col("x").alias("p"))
        moved = both.groupBy("x").agg(first).select("x", F.least("m", own)["p"].alias("p"))
        move = settle(moved.filter("x <> p"))
        moves.append(move)
        to_a = Sized(move.df.select(F.col("x").alias("a"), F.col("p").alias("pa")), move.rows, move.bytes)
        to_b = Sized(move.df.select(F.col("x").alias("b"), F.col("p").alias("pb")), move.rows, move.bytes)
        shifted = common.join_checked(common.join_checked(current.df, to_a, ["a"], "left"), to_b, ["b"], "left")
        shifted = shifted.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).filter("a <> b")
        current = settle(shifted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not moves:
        return None
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    roots = nodes.withColumn("root", F.col("node"))
    for move in moves:
        step = Sized(move.df.select(F.col("x").alias("root"), F.col("p").alias("_to")), move.rows, move.bytes)
        roots = common.join_checked(roots, step, ["root"], "left").select("node", F.coalesce("_to", "root").alias("root"))
    return roots


def classes(docs: DataFrame, text: str = "text", words: int = WORDS, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (the smallest id reachable over links).

    Null and empty texts have fingerprint 0 and are linked like any other. Null ids are passed over
    for ``component_id``, which is null where a class has no id. Repeated rows give repeated rows.
    An empty table gives an empty result; further columns are ignored.
    """
    marked = fingerprints(docs, text, words)
    distinct = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("_least"))).df
    roots = components(links(distinct.select("fp"), bits, hot))
    if roots is None:
        named = distinct.select("fp", F.col("_least").alias("component_id"))
    else:
        of = settle(roots.select(F.col("node").alias("fp"), "root"))
        rooted = settle(
            common.join_checked(distinct, of, ["fp"], "left").select("fp", F.coalesce("root", "fp").alias("_root"), "_least")
        )
        least = settle(rooted.df.groupBy("_root").agg(F.min("_least").alias("component_id")))
        named = common.join_checked(rooted.df, least, ["_root"]).select("fp", "component_id")
    return common.join_checked(marked, settle(named), ["fp"]).select("doc_id", "fp", "component_id")
