"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The texts of a block (a slice of an Arrow batch, cut at ``BLOCK_CHARS``) are split into pre-tokens, and the
block's distinct pre-tokens are laid out in one array of symbols. An inverted index leads from a
merge to the positions where its pair stands. Merges are applied to the whole block in rank order;
each one touches only its own positions, and only their neighbours are looked up again. The
encoded pre-tokens then make up every text of the block. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common

BLOCK_CHARS = 1 << 22
# Encoded pre-tokens that a Python worker remembers between blocks.
REMEMBERED = 50_000
# Symbols whose pairs are looked up at a time when a replay begins.
_AT_ONCE = 1 << 17
_STAND_IN = {"L": "ª", "N": "²", "": "§"}


def read_ranks(path: str) -> bytes:
    """The rank file, one ``base64 rank`` pair a line; read on the driver and sent to the workers."""
    return Path(path).read_bytes()


class _Ids(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def _take(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[start : start + length]``."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return flat[shift + np.arange(total)]


def odd_characters() -> dict[int, str]:
    """Characters that the regular expression module and the tokenizer library classify differently.

    The module has a newer Unicode table. Each such character is mapped to one that both take for
    what the library takes it for: a letter, a digit or neither. Found once, on the driver.
    """
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    known, seen = {}, {}
    for kind in "LN":
        one = tiktoken.Encoding(kind, pat_str=rf"\p{{{kind}}}+", mergeable_ranks=single, special_tokens={})
        known[kind] = set(bytes(one.encode_ordinary(every)).decode())
        seen[kind] = set("".join(regex.findall(rf"\p{{{kind}}}+", every)))
    odd = (known["L"] ^ seen["L"]) | (known["N"] ^ seen["N"])
    return {ord(c): _STAND_IN["L" if c in known["L"] else "N" if c in known["N"] else ""] for c in odd}


class Splitter:
    """Pre-tokens of a text; odd characters are replaced, for splitting only, by their stand-ins."""

    def __init__(self, pattern: str, stand_in: dict[int, str]):
        self.find = regex.compile(pattern).findall
        self.iterate = regex.compile(pattern).finditer
        self.stand_in = stand_in
        self.maybe_odd = regex.compile(f"[{chr(min(stand_in))}-\U0010ffff]").search if stand_in else None

    def __call__(self, text: str) -> Iterable[str]:
        if self.maybe_odd is not None and self.maybe_odd(text):
            swapped = text.translate(self.stand_in)
            return (text[m.start() : m.end()] for m in self.iterate(swapped))
        if len(text) > BLOCK_CHARS:
            return (m.group() for m in self.iterate(text))
        return self.find(text)

    def windowed(self, text: str, at: int, size: int, context: int) -> Iterator[str]:
        """Pre-tokens of ``text`` from ``at`` on, as they are needed; one has to begin there.

        Windows of the text are split; a pre-token that ends within ``context`` of a window's end is split again in the next, longer one.
        """
        while at < len(text):
            stop = at + size
            if stop >= len(text):
                yield from self(text[at:])
                return
            for piece in self(text[at:stop]):
                if at + len(piece) > stop - context:
                    break
                yield piece
                at += len(piece)
            size *= 2


class Codec:
    """Encodes pre-tokens by merge replay and decodes ids, for one rank file and one pattern."""

    def __init__(self, ranks: bytes, pattern: str, stand_in: dict[int, str] | None = None):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.split = Splitter(pattern, odd_characters() if stand_in is None else stand_in)
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        # Every way to put a token together from two tokens: key (left, right) -> rank.
        keys, values = [], []
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                left, right = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(keys)
        self.pair_keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(values, dtype=np.int64)[order], -1)
        self.known: dict[str, np.ndarray] = {}
        self.pattern, self.single_piece = pattern, None

    def _merge_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def _one(self, piece: bytes) -> list[int]:
        """One pre-token, lowest rank first, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))) if len(parts) > 1 else (1 << 60, 0)
            if best[0] == 1 << 60:
                return [self.ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` behind one another, and how many each word has."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym = self.single.astype(np.int32)[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(sym)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        last = np.cumsum(lengths) - 1
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[last] = -1
        prv[last - lengths + 1] = -1
        alive, merged = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
        current = np.full(n, -1, dtype=np.int32)
        inner = np.flatnonzero(nxt >= 0).astype(np.int32)
        for begin in range(0, len(inner), _AT_ONCE):
            part = inner[begin : begin + _AT_ONCE]
            current[part] = self._merge_rank(sym[part], sym[nxt[part]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd_words: list[np.ndarray] = []

        def enter(positions: np.ndarray) -> None:
            found = current[positions]
            positions, found = positions[found >= 0], found[found >= 0]
            order = np.argsort(found, kind="stable")
            positions, found = positions[order], found[order]
            starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else []
            for rank, chunk in zip(found[starts].tolist() if len(found) else [], np.split(positions, starts[1:]) if len(found) else []):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(heap, rank)
                index[rank].append(chunk)

        enter(inner)
        while heap:
            rank = heapq.heappop(heap)
            chunks = index.pop(rank)
            at = np.concatenate(chunks) if len(chunks) > 1 else chunks[0]
            at = at[current[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                at = at[np.append(True, at[1:] != at[:-1])]
                # Of overlapping places (a a a) the first, third, .. merge.
                linked = np.r_[False, nxt[at[:-1]] == at[1:]]
                if linked.any():
                    run = np.arange(len(at))
                    begin = np.maximum.accumulate(np.where(linked, 0, run))
                    at = at[(run - begin) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = rank
            alive[gone] = False
            current[gone] = -1
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            merged[at] = True
            before = prv[at]
            before = before[before >= 0]
            touched = np.concatenate([at, before[~merged[before]]])
            merged[at] = False
            right = nxt[touched]
            ends = right < 0
            current[touched[ends]] = -1
            touched, right = touched[~ends], right[~ends]
            current[touched] = self._merge_rank(sym[touched], sym[right])
            # A merge that opens one of lower rank would have to go first in its own word: redo such words singly.
            lower = touched[(current[touched] >= 0) & (current[touched] < rank)]
            if len(lower):
                odd_words.append(word[lower])
            enter(touched)
        counts = np.bincount(word[alive], minlength=len(words))
        ids = sym[alive]
        odd = np.unique(np.concatenate(odd_words)).tolist() if odd_words else []
        whole = [i for i, w in enumerate(words) if counts[i] > 1 and w in self.ranks]
        if odd or whole:
            # A pre-token that is a token itself is taken as it is.
            single = {i: np.array(self._one(words[i])) for i in odd} | {i: np.array([self.ranks[words[i]]]) for i in whole}
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, own in single.items():
                parts[i], counts[i] = own, len(own)
            ids = np.concatenate(parts)
        return ids, counts

    def _table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, count and flat ids of pre-tokens; remembered ones are not replayed."""
        fresh = [w for w in words if w not in self.known]
        counts = np.zeros(len(words), dtype=np.int64)
        if fresh:
            ids, n = self.replay([w.encode("utf-8") for w in fresh])
        else:
            ids, n = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        old = np.fromiter((w in self.known for w in words), dtype=bool, count=len(words))
        kept = [self.known[w] for w, o in zip(words, old.tolist()) if o]
        starts = np.zeros(len(words), dtype=np.int64)
        counts[~old] = n
        starts[~old] = np.cumsum(n) - n
        lengths = np.fromiter(map(len, kept), dtype=np.int64, count=len(kept))
        counts[old] = lengths
        starts[old] = len(ids) + np.cumsum(lengths) - lengths
        flat = np.concatenate([ids, *kept]) if kept else ids
        room = REMEMBERED - len(self.known)
        # Pre-tokens come in the order of their first use: the early ones are the frequent ones.
        for w, s, c in zip(fresh[:room], starts[~old][:room].tolist(), n[:room].tolist()):
            self.known[w] = flat[s : s + c].copy()
        return starts, counts, flat

    def encode_block(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text."""
        numbers = _Ids()
        split = [np.fromiter(map(numbers.__getitem__, self.split(t)), dtype=np.int32) if t else None for t in texts]
        none = np.empty(0, dtype="<u4")
        if not numbers:
            return [none for _ in texts]
        starts, counts, flat = self._table(list(numbers))
        flat = flat.astype("<u4")
        return [none if s is None else _take(starts[s], counts[s], flat) for s in split]

    def counts_of(self, pretokens: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        if self.single_piece is None:
            import tiktoken

            own = tiktoken.Encoding("counts", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
            self.single_piece = own._core_bpe.encode_single_piece
        return np.fromiter((len(self.single_piece(p.encode("utf-8"))) for p in pretokens), dtype=np.int64, count=len(pretokens))

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of every text, block by block."""
        block: list[str | None] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield from self.encode_block(block)
                block, size = [], 0
        yield from self.encode_block(block)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def codec(ranks: bytes, pattern: str, stand_in: dict[int, str] | None = None) -> Codec:
    """The codec of a rank file; one is kept per Python worker."""
    key = hashlib.md5(ranks + pattern.encode()).hexdigest()
    return common.kept("codec", key, lambda: Codec(ranks, pattern, stand_in))


class Tokenizer:
    """A rank file (by path) and a pattern, made available to the workers once; its size is that of the file."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.shared = spark.sparkContext.broadcast((read_ranks(path), odd_characters()))
        self.pattern = pattern

    def codec(self) -> Codec:
        ranks, stand_in = self.shared.value
        return codec(ranks, self.pattern, stand_in)


def encode(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default: all but the text) with ``ids`` and ``decoded``.

    ``ids`` are little-endian unsigned 32-bit integers in one binary value, ``decoded`` the bytes
    that they stand for. Null text has no ids. Each pre-token is encoded by itself and no special
    token is ever made. Rows are independent: repeated ids and an empty table need no care. Columns
    named ``ids`` or ``decoded`` are replaced.
    """
    carried = [c for c in (columns if columns is not None else docs.columns) if c not in (text, "ids", "decoded")]

    def make(texts: list[str | None]) -> list[pa.Array]:
        own = tokenizer.codec()
        ids, decoded = [], []
        for found in own.encode(texts):
            ids.append(found.tobytes())
            decoded.append(own.decode(found))
        return [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]

    return common.map_texts(docs, text, carried, make, "ids binary, decoded binary")


def decode(encoded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``encoded`` with ``decoded`` made again from its ``ids``; null ids decode to no bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = tokenizer.codec()
        for frame in frames:
            out = [codec.decode(np.frombuffer(x or b"", dtype="<u4")) for x in frame["ids"]]
            yield frame.assign(decoded=out)

    rows = encoded.drop("decoded")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, kinds + ", decoded binary")
