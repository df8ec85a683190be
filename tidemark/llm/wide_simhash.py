"""Wide SimHash fingerprints of shingle sets, met by anchor-point covering.

At a Jaccard similarity of 0.8 two fingerprints differ in 15 % of their bits, far more than a covering of the whole
fingerprint reaches. A fingerprint of 320 bits is therefore cut into ``BLOCKS`` blocks of 23, each covered on its own: the
anchors are the words of a [15,11] Hamming code with eight free bits, covering radius 1, and a block is replicated
to all anchors within covering radius plus threshold (1 + 1 = 2), 17 on average. Blocks that differ in at most one bit
always share an anchor, most that differ in two and some that differ in three or four do too: 41 % of the blocks of a pair at
0.8, so all but one such pair in a thousand meet in one of the blocks, however many texts there are.

By chance an anchor also holds unlike texts. Bits from outside the block travel along and tell them from near ones, so
that only nodes with a near partner leave the comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.session import Sized, settle

BITS = 320
CODED = 15
FREE = 8
BLOCKS = BITS // (CODED + FREE)
# Nodes of an anchor that are compared in all pairs at once; in larger ones each node takes the first near one.
PAIRED = 256
# Entries that a task looks at together.
_TOGETHER = 1 << 18
_MIX = np.random.default_rng(43).integers(1, 1 << 63, size=(2, BITS // 64), dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(hashes: np.ndarray) -> bytes | None:
    """Majority bits of ``BITS`` hash bits per shingle; none for an empty set."""
    if not len(hashes):
        return None
    z = (hashes[:, None] ^ _MIX[0]) * _MIX[1]
    z ^= z >> np.uint64(32)
    z *= _ODD
    z ^= z >> np.uint64(29)
    counts = np.zeros(BITS, dtype=np.int64)
    # 255 ones fit a byte.
    for begin in range(0, len(z), 255):
        bits = np.unpackbits(z[begin : begin + 255].view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def words(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype="<u8").reshape(len(values), BITS // 64)


def reach(similarity: float, bits: int = BITS) -> int:
    """How many bits a pair at the threshold differs in at most: the expectation plus four and a half deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + 4.5 * math.sqrt(bits * p * (1 - p)))


def close(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether fingerprints, or leading words of them, may belong to sets of this similarity."""
    return np.bitwise_count(x ^ y).sum(axis=-1) <= reach(similarity, 64 * x.shape[-1])


def _flips() -> list[np.ndarray]:
    """Per syndrome, what to flip in a block to reach every anchor within distance 2; coded positions are 1 .. 15."""
    free = [1 << (CODED + i) for i in range(FREE)]
    out = []
    for s in range(CODED + 1):
        nearest = (1 << (s - 1)) if s else 0
        masks = [nearest, *[nearest | f for f in free]]
        if s:
            masks += [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, CODED + 1) if i < i ^ s]
        else:
            masks += [f | g for f in free for g in free if f < g]
        out.append(np.array(masks, dtype=np.int64))
    return out


_FLIPS = _flips()
_SYNDROMES = np.bitwise_xor.reduce([(np.arange(1 << CODED) >> (i - 1) & 1) * i for i in range(1, CODED + 1)])


def blocks(marks: np.ndarray) -> np.ndarray:
    """The blocks of fingerprints as numbers, a column each."""
    size = CODED + FREE
    out = np.empty((len(marks), BLOCKS), dtype=np.int64)
    for b in range(BLOCKS):
        at, shift = divmod(b * size, 64)
        value = marks[:, at] >> np.uint64(shift)
        if shift + size > 64:
            value = value | marks[:, at + 1] << np.uint64(64 - shift)
        out[:, b] = (value & np.uint64((1 << size) - 1)).astype(np.int64)
    return out


def anchors(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``row, anchor`` for all anchors within distance 2 of every block value."""
    syndromes = _SYNDROMES[block & ((1 << CODED) - 1)]
    rows, found = [], []
    for s, flips in enumerate(_FLIPS):
        at = np.flatnonzero(syndromes == s)
        rows.append(np.repeat(at, len(flips)))
        found.append((block[at, None] ^ flips).ravel())
    return np.concatenate(rows), np.concatenate(found)


def _half(b: int) -> int:
    """First of the two words that travel with block ``b``: of the half that the block is not in."""
    return BITS // 64 - 2 if b < BLOCKS // 2 else 0


def entries(nodes: DataFrame) -> DataFrame:
    """Rows ``key, node, t0, t1``: every node at its anchors, with 128 other bits of its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                node, marks = part.column(0).to_numpy(), words(part.column(1).to_pylist())
                each = blocks(marks)
                for b in range(BLOCKS):
                    rows, found = anchors(each[:, b])
                    tags = marks[rows, _half(b) : _half(b) + 2].view(np.int64)
                    key = (found | b << (CODED + FREE)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[rows]), pa.array(tags[:, 0]), pa.array(tags[:, 1])], names=["key", "node", "t0", "t1"])

    return nodes.filter("sketch IS NOT NULL").select("node", "sketch").mapInArrow(run, "key int, node long, t0 long, t1 long")


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = (a.astype(np.uint64) * _ODD) ^ b.view(np.uint64)
    z ^= z >> np.uint64(32)
    return (z * _MIX[1, 0]).view(np.int64)


def _paired(key, node, tags, starts, sizes, similarity):
    """Near nodes of small anchors: pairs at every distance in the order, then the connected ones share a key and a head."""
    pos, size = np.arange(len(key)) - np.repeat(starts, sizes), np.repeat(sizes, sizes)
    a, b = [], []
    at = np.arange(len(key))
    for step in range(1, int(sizes.max())):
        at = at[pos[at] + step < size[at]]
        hit = at[close(tags[at], tags[at + step], similarity)]
        a.append(hit)
        b.append(hit + step)
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
    root, first = np.arange(len(key)), np.arange(len(key))
    np.minimum.at(first, b, a)
    while True:
        least = np.minimum(root[a], root[b])
        if (root[a] == least).all() and (root[b] == least).all():
            break
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
    met = np.union1d(a, b)
    head = node[root[met]]
    return _mixed(key[met], head), node[met], node[first[met]], head


def _starred(key, node, tags, similarity):
    """Near nodes of one large anchor: each takes the first near node that took none; a node that took none looks at all."""
    first = np.arange(len(key))
    met = np.zeros(len(key), dtype=bool)
    for i in range(len(key)):
        if first[i] < i:
            continue
        near = close(tags, tags[i], similarity)
        near[i] = False
        if near.any():
            met[i] = True
            met |= near
            near[:i] = False
            first[near & (first == np.arange(len(key)))] = i
    n = int(met.sum())
    return _mixed(key[met], np.zeros(n, np.int64)), node[met], node[first[met]], np.repeat(node[met][:1], n)


def met(nodes: DataFrame, similarity: float) -> Sized:
    """Rows ``key, node, pivot, head``: per anchor the nodes with a near one, the first node near to each, and the first of its key."""

    def near(key, node, tags):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        found = []
        small = sizes[(sizes > 1) & (sizes <= PAIRED)]
        if len(small):
            own = np.repeat((sizes > 1) & (sizes <= PAIRED), sizes)
            found.append(_paired(key[own], node[own], tags[own], np.cumsum(small) - small, small, similarity))
        for s, n in zip(starts[sizes > PAIRED], sizes[sizes > PAIRED]):
            found.append(_starred(key[s : s + n], node[s : s + n], tags[s : s + n], similarity))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["key", "node", "pivot", "head"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                rows += batch.num_rows
            if rows < _TOGETHER or held[-1][0][-1] == held[0][0][0]:
                continue
            key, node, t0, t1 = (np.concatenate(c) for c in zip(*held))
            cut = int(np.searchsorted(key, key[-1]))
            yield from near(key[:cut], node[:cut], np.stack([t0[:cut], t1[:cut]], axis=1).view(np.uint64))
            held, rows = [[c[cut:] for c in (key, node, t0, t1)]], len(key) - cut
        if rows:
            key, node, t0, t1 = (np.concatenate(c) for c in zip(*held))
            yield from near(key, node, np.stack([t0, t1], axis=1).view(np.uint64))
        common.give_back()

    common.small_batches(nodes.sparkSession)
    placed = entries(nodes).repartition("key").sortWithinPartitions("key", "node")
    return settle(placed.mapInArrow(run, "key long, node long, pivot long, head long"))
