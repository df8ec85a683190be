"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens: a leaf covers about ``LEAF`` pre-tokens, every node
holds the sums of characters and of tokens below it. An edit finds its leaf by descent, splits again only from
there, with boundary context on its left, until a new pre-token begins where an old leaf began behind
the edit; from there on nothing can differ, since a pre-token depends on no text before it. Only those
pre-tokens are encoded, and only sums above changed leaves are updated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.byte_bpe import Codec, Tokenizer, _Ids

LEAF = 16
# Counts are small, so a worker takes more text at a time than for ids.
SLICE_BYTES = 2 * common.SLICE_BYTES
# The end of a pre-token depends on at most so many characters behind it (contractions, white space).
CONTEXT = 3
# Characters that an edit splits at first; doubled while no old border is met.
_WINDOW = 256
STATE = "char_tree array<int>, tree array<int>"
EDIT = "array<struct<start:int,end:int,text:string>>"


def tree_of(leaves: np.ndarray) -> np.ndarray:
    """Heap-shaped sums: node i has children 2i and 2i + 1, leaves from ``len / 2`` on, node 1 is the total."""
    width = 1 << max(0, int(len(leaves) - 1).bit_length())
    tree = np.zeros(2 * width, dtype=np.int64)
    tree[width : width + len(leaves)] = leaves
    level = width
    while level > 1:
        tree[level // 2 : level] = tree[level : 2 * level : 2] + tree[level + 1 : 2 * level : 2]
        level //= 2
    return tree


def set_leaf(tree: list[int] | np.ndarray, leaf: int, value: int) -> None:
    node = len(tree) // 2 + leaf
    change = value - tree[node]
    while node and change:
        tree[node] += change
        node //= 2


def leaf_at(tree: list[int], offset: int) -> tuple[int, int]:
    """The leaf that holds the character at ``offset`` and the leaf's first character; behind the end the last leaf."""
    width = len(tree) // 2
    offset = min(offset, tree[1] - 1)
    node, begin = 1, 0
    while node < width:
        node *= 2
        if offset - begin >= tree[node]:
            begin += tree[node]
            node += 1
    return node - width, begin


class Edited:
    """A text with its two trees while edits are applied; token counts of new leaves follow in ``finish``."""

    def __init__(self, text: str, char_tree: list[int], tree: list[int]):
        self.text, self.chars, self.tree = text, char_tree, tree
        # New leaves: the numbers of their pre-tokens.
        self.fresh: dict[int, list[int]] = {}
        self.split_chars = 0

    def leaves(self) -> int:
        """A leaf without characters is padding."""
        width = len(self.chars) // 2
        return int(np.count_nonzero(self.chars[width:]))

    def apply(self, codec: Codec, numbers: _Ids, start: int, end: int, text: str) -> None:
        start = min(max(0, start), len(self.text))
        end = min(max(start, end), len(self.text))
        first, begin = leaf_at(self.chars, max(0, start - CONTEXT)) if self.text else (0, 0)
        width = len(self.chars) // 2
        self.text = self.text[:start] + text + self.text[end:]
        # The next old border at or behind the edit, in old positions.
        shift, settled = len(text) - (end - start), start + len(text)
        last, border = leaf_at(self.chars, end) if self.chars[1] else (0, 0)
        if border < end:
            border += self.chars[width + last]
            last += 1
        at, made, lengths = begin, [], []
        for piece in codec.split.windowed(self.text, begin, _WINDOW, CONTEXT):
            if at >= settled and made:
                while border + shift < at and border < self.chars[1]:
                    border += self.chars[width + last]
                    last += 1
                if border + shift == at:
                    break
            made.append(numbers[piece])
            lengths.append(len(piece))
            at += len(piece)
        else:
            last = -1
        self.split_chars += at - begin
        self._replace(first, last, made, lengths)

    def _replace(self, first: int, last: int, made: list[int], lengths: list[int]) -> None:
        """Leaves from ``first`` up to ``last`` (-1: all the rest) become leaves of the pre-tokens ``made``."""
        width = len(self.chars) // 2
        number = self.leaves() if last < 0 else last
        old = number - first
        # The same number of leaves if they do not get too full: then only paths are updated.
        if 0 < old <= len(made) <= 2 * LEAF * old:
            cuts = [i * len(made) // old for i in range(old + 1)]
            for leaf, a, b in zip(range(first, number), cuts, cuts[1:]):
                set_leaf(self.chars, leaf, sum(lengths[a:b]))
                self.fresh[leaf] = made[a:b]
            return
        total = self.leaves()
        new = -(-len(made) // LEAF)
        cuts = [i * len(made) // new for i in range(new + 1)] if new else [0]
        parts = list(zip(cuts, cuts[1:]))
        chars = self.chars[width : width + total]
        chars[first:number] = [sum(lengths[a:b]) for a, b in parts]
        tokens = self.tree[width : width + total]
        tokens[first:number] = [0] * new
        kept = {(i if i < first else i + new - old): v for i, v in self.fresh.items() if not first <= i < number}
        self.fresh = kept | {first + i: made[a:b] for i, (a, b) in enumerate(parts)}
        self.chars = tree_of(np.array(chars, dtype=np.int64)).tolist()
        self.tree = tree_of(np.array(tokens, dtype=np.int64)).tolist()

    def finish(self, counts: list[int]) -> None:
        """Fill in the tokens of new leaves and update the sums above them."""
        for leaf, held in self.fresh.items():
            set_leaf(self.tree, leaf, sum(map(counts.__getitem__, held)))
        self.fresh = {}


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _grow(codec: Codec, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Trees of characters and of tokens of new texts; their distinct pre-tokens are counted together."""
    numbers = _Ids()
    split = [np.fromiter(map(numbers.__getitem__, codec.split(t or "")), dtype=np.int32) for t in texts]
    words = list(numbers)
    counts = codec.counts_of(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    chars, trees = [], []
    for held in split:
        starts = np.arange(0, len(held), LEAF)
        for values, out in ((lengths, chars), (counts, trees)):
            out.append(tree_of(np.add.reduceat(values[held], starts) if len(held) else np.empty(0, dtype=np.int64)))
    return chars, trees


def build(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default: all) with the state ``char_tree, tree``; ``total`` reads its count.

    Null text counts as empty: no leaf, count 0. Rows are independent.
    """
    carried = common.without(docs.select(*(columns or docs.columns)), ["char_tree", "tree"]).columns

    def make(texts: list[str | None]) -> list[pa.Array]:
        return [_lists(x) for x in _grow(tokenizer.codec(), texts)]

    return common.map_texts(docs, text, carried, make, STATE, SLICE_BYTES)


def total(tree: str = "tree"):
    """The token count that a state holds."""
    return F.element_at(tree, 2).cast("long")


def _edit(codec: Codec, texts: list[str | None], chars: list[np.ndarray], trees: list[np.ndarray], asked: list[list | None]) -> list[Edited]:
    numbers, done = _Ids(), []
    for body, char_tree, tree, edits in zip(texts, chars, trees, asked):
        own = Edited(body or "", char_tree.tolist(), tree.tolist())
        for e in edits or []:
            own.apply(codec, numbers, e["start"] or 0, e["end"] or 0, e["text"] or "")
        done.append(own)
    counts = codec.counts_of(list(numbers)).tolist()
    for own in done:
        own.finish(counts)
    return done


def _states(done: list[Edited]) -> list[pa.Array]:
    return [_lists([np.array(own.chars, dtype=np.int64) for own in done]), _lists([np.array(own.tree, dtype=np.int64) for own in done])]


def apply_edits(state: DataFrame, tokenizer: Tokenizer, text: str = "text", edits: str = "edits") -> DataFrame:
    """``state`` after its edits: new text, ``char_tree`` and ``tree``, and ``split_chars``, the characters split again.

    ``edits`` (``EDIT``) are applied one after another: [start, end) of the text as it is then, clipped to
    it, becomes ``text``. Null edits, null positions (0) and null texts (empty) are allowed.
    """
    others = [c for c in state.columns if c not in (text, "char_tree", "tree", edits, "split_chars")]
    return _mapped(state, tokenizer, text, others, [edits, "char_tree", "tree"], edited=True)


def build_and_edit(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", edits: str = "edits", columns: list[str] | None = None) -> DataFrame:
    """``build`` and ``apply_edits`` in one pass over the texts; ``n_tokens`` is the count before the edits."""
    asked = [c for c in (columns if columns is not None else docs.columns) if c not in (text, edits)]
    others = common.without(docs.select(*[F.col(f"`{c}`") for c in asked]), ["char_tree", "tree", "split_chars", "n_tokens"]).columns
    return _mapped(docs, tokenizer, text, others, [edits], edited=False)


def _mapped(rows: DataFrame, tokenizer: Tokenizer, text: str, others: list[str], work: list[str], edited: bool) -> DataFrame:
    common.small_batches(rows.sparkSession)
    slim = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([*others, *work, text])])
    base, added = len(others), "_text string, " + STATE + ", split_chars long" + ("" if edited else ", n_tokens long")
    names = [f"c{i}" for i in range(base)] + [part.split()[0] for part in added.split(", ")]

    def made(part: pa.RecordBatch, codec: Codec) -> pa.RecordBatch:
        texts = part.column(part.num_columns - 1).to_pylist()
        asked = part.column(base).to_pylist()
        if edited:
            chars, trees = ([np.array(v.as_py(), dtype=np.int64) for v in part.column(base + i)] for i in (1, 2))
        else:
            chars, trees = _grow(codec, texts)
        before = [int(tree[1]) for tree in trees]
        done = _edit(codec, texts, chars, trees, asked)
        out = [pa.array([own.text for own in done], pa.string()), *_states(done), pa.array([own.split_chars for own in done], pa.int64())]
        out += [] if edited else [pa.array(before, pa.int64())]
        return pa.RecordBatch.from_arrays([*[part.column(i) for i in range(base)], *out], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokenizer.codec()
        for batch in batches:
            for part in common.slices(batch, SLICE_BYTES):
                yield made(part, codec)

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in slim.schema.fields[:base])
    out = slim.mapInArrow(run, kinds + added)
    named = [F.col(f"c{i}").alias(c) for i, c in enumerate(others)]
    return out.select(*named, F.col("_text").alias(text), *names[base + 1 :])
