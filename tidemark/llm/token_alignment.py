"""Alignment of the tokens of two tokenizers by diagonal run skipping.

Tokenizer A (a JSON file of byte-level BPE) and tokenizer B (a sentence piece model, which puts a space in front)
encode the same text. The end offsets of their tokens are two rising arrays. At the current shift between the
two indices, ends are compared over stretches that double in length: a stretch in which all agree is one group
per token and is jumped over; at the first disagreement the smaller end advances until both meet, which makes
an irregular group, and the shift changes by the difference of its token counts.

Texts are handled in blocks of about ``BLOCK_BYTES``. A single space between two letters or signs always
begins a token of either tokenizer, so a block's texts are cut there into units, and each distinct unit is encoded and
aligned once. A block writes one row per document (its counts, and how often it has which of the block's token pairs)
and one per distinct pair. Spark sums the pairs of all blocks, finds the highest count of every B id, and joins the counts
back per (block, pair): a pair costs a block one row, however often it occurs there, and no document's tokens are shuffled
by pair. A block's counts and then its documents come to one task in that order and are read as they come, so
neither a row nor a task holds a whole block.

Texts that are null, empty, or that a tokenizer does not give back byte by byte have no tokens and zeros. Rows are
independent: repeated ids and rows count each, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common
from tidemark.llm.byte_bpe import _Ids
from tidemark.session import settle

BLOCK_BYTES = 8 * 1024 * 1024
# Cuts between units: one space with a printable ASCII sign or a Latin letter on either side.
_CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
# A piece that reaches over such a cut: one of those signs, or the end of one, and a space.
_OVER = re.compile(rb"(?:[!-~]|[\xc3-\xc9][\x80-\xbf]|^[\x80-\xbf]) ")
_SPACE = "▁"
# The split of byte-level BPE, and the characters for which the quick encoder is asked.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_COMMON = re.compile("[\t\n\r -~À-ɏ]*").fullmatch
# Distinct units that are encoded and aligned at a time.
_UNITS = 1 << 14
# Rows of pairs, and bytes of the documents' pairs, that leave a worker at a time.
_PAIRS = 1 << 16
_COUNT_BYTES = 1 << 20
_ADDED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level BPE writes for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    """Bytes of a sentence piece: ``<0xHH>`` is that byte, U+2581 a space."""
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(_SPACE, " ").encode("utf-8")


def as_ranks(a_json: str) -> dict[bytes, int] | None:
    """Byte ranks equal to a JSON vocabulary, or None if its merges are not in the order of their ids or it does more than merge."""
    told = json.loads(a_json)
    model, split = told["model"], told.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not told.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
    plain = plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    plain = plain and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    letters = byte_alphabet()
    special = {t["content"] for t in told.get("added_tokens", [])}
    if not plain or not all(t.get("special") for t in told.get("added_tokens", [])):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(x + y, -1) for x, y in merges]
    single = [model["vocab"].get(c, -1) for c in letters]
    if not made or min(single) < 0 or made != sorted(set(made)) or max(single) > made[0]:
        return None
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    return ranks if len(ranks) == len(made) + len(single) else None


class Pair:
    """Both tokenizers in one worker: encoders, the bytes and the printed form of every id."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        # Strings of special tokens inside a text are plain text.
        self.a.encode_special_tokens = True
        ranks = as_ranks(a_json)
        # Merging by rank gives the same ids sooner; it is asked only for characters that all Unicode tables class alike.
        self.quick = ranks and tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, number in vocabulary.items():
            self.a_bytes[number] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_length = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        # The ids in print, looked up and not made again for every token.
        self.number = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        # Units are exact only if no piece reaches over a space that follows a letter.
        self.cut = None if any(map(_OVER.search, [*self.a_bytes, *self.b_bytes])) else _CUT

    def units(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut else [text]

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of space+unit by A, of the unit by B; none where the joined bytes differ from space+unit."""
        spaced = [" " + u for u in units]
        if self.quick:
            a = [self.quick(u) if _COMMON(u) else self.a.encode(u, add_special_tokens=False).ids for u in spaced]
        else:
            a = [e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        for table, found in ((self.a_bytes, a), (self.b_bytes, b)):
            pieces = [b"".join(map(table.__getitem__, ids)) for ids in found]
            for i, (u, piece) in enumerate(zip(spaced, pieces)):
                if piece != u.encode("utf-8"):
                    a[i] = b[i] = []
        return a, b


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First A and first B index of every group; both arrays rise and end at the same offset."""
    n = len(ends_a)
    firsts: list[tuple[int, int, int]] = []
    i = j = 0
    # Short stretches are compared value by value, long ones as slices.
    a, b = ends_a.tolist(), ends_b.tolist()
    while i < n:
        begin, size = i, 1
        while i < n and a[i] == b[j]:
            i, j = i + 1, j + 1
            size += 1
            if size > 8:
                # The stretch goes on: jump by doubling as long as every end agrees.
                while i < n:
                    upto = min(size, n - i, len(b) - j)
                    same = ends_a[i : i + upto] == ends_b[j : j + upto]
                    step = upto if same.all() else int(same.argmin())
                    i, j, size = i + step, j + step, 2 * size
                    if step < upto or not upto:
                        break
                break
        if i > begin:
            firsts.append((begin, j - i + begin, i - begin))
        if i < n and a[i] != b[j]:
            firsts.append((i, j, 1))
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i, j = i + 1, j + 1
    if not firsts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    runs = np.array(firsts, dtype=np.int64)
    inside = np.arange(runs[:, 2].sum()) - np.repeat(np.cumsum(runs[:, 2]) - runs[:, 2], runs[:, 2])
    return np.repeat(runs[:, 0], runs[:, 2]) + inside, np.repeat(runs[:, 1], runs[:, 2]) + inside


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A and B index of all pairs of tokens whose byte ranges overlap: one pair per stretch between ends of either."""
    cuts = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)


def shown(number: list[str], a: list[int], b: list[int], first_a: list[int], first_b: list[int]) -> list[str]:
    """``a1,a2|b1`` per group."""
    text_a, text_b = list(map(number.__getitem__, a)), list(map(number.__getitem__, b))
    out = []
    for i, k, j, m in zip(first_a, [*first_a[1:], len(a)], first_b, [*first_b[1:], len(b)]):
        left = text_a[i] if k == i + 1 else ",".join(text_a[i:k])
        right = text_b[j] if m == j + 1 else ",".join(text_b[j:m])
        out.append(left + "|" + right)
    return out


class Units:
    """The distinct units of a block, encoded and aligned: per unit its counts, its printed groups and its links.

    A link is a number of ``pairs``, which rise. ``words`` is emptied on the way.
    """

    def __init__(self, pair: Pair, words: list[str]):
        parts, self.text = [], []
        words.reverse()
        while words or not parts:
            part = words[: -_UNITS - 1 : -1]
            del words[-_UNITS:]
            *counts, said = self._part(pair, part)
            self.text += said
            parts.append(counts)
        n_a, n_b, n_groups, n_links, pairs, links = zip(*parts)
        self.n_a, self.n_b, self.n_groups, self.n_links = map(np.concatenate, (n_a, n_b, n_groups, n_links))
        self.pairs = np.unique(np.concatenate(pairs))
        self.links = np.concatenate([np.searchsorted(self.pairs, p).astype(np.int32)[at] for p, at in zip(pairs, links)])
        self.first = np.cumsum(self.n_links) - self.n_links
        self.fits = self.n_a > 0

    @staticmethod
    def _part(pair: Pair, words: list[str]) -> tuple:
        a, b = pair.encode(words)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(words)) for x in (a, b))
        list_a, list_b = (list(chain.from_iterable(x)) for x in (a, b))
        flat_a, flat_b = np.array(list_a, dtype=np.int64), np.array(list_b, dtype=np.int64)
        # All units behind one another are one text of the two tokenizers: every unit ends with a group.
        ends_a, ends_b = np.cumsum(pair.a_length[flat_a]), np.cumsum(pair.b_length[flat_b])
        first_a, first_b = groups(ends_a, ends_b)
        stops = np.cumsum(n_a)
        upto = np.searchsorted(first_a, stops)
        n_groups = np.diff(upto, prepend=0)
        text = shown(pair.number, list_a, list_b, first_a.tolist(), first_b.tolist())
        said = [";".join(text[s : s + n]) for s, n in zip((upto - n_groups).tolist(), n_groups.tolist())]
        link_a, link_b = links(ends_a, ends_b)
        n_links = np.diff(np.searchsorted(link_a, stops), prepend=0)
        pairs, at = np.unique(flat_a[link_a] << 32 | flat_b[link_b], return_inverse=True)
        return n_a, n_b, n_groups, n_links, pairs, at.astype(np.int32), said

    def counted(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that the units ``of`` a text link, as rising numbers, and how often; long texts in stretches."""
        found = []
        for i in range(0, len(of), _UNITS):
            part = of[i : i + _UNITS]
            n = self.n_links[part]
            at = np.repeat(self.first[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(np.unique(self.links[at], return_counts=True))
        if len(found) == 1:
            return found[0]
        number, times = map(np.concatenate, zip(*found)) if found else np.zeros((2, 0), np.int64)
        number, at = np.unique(number, return_inverse=True)
        return number, np.bincount(at, weights=times, minlength=len(number)).astype(np.int64)


def packed(number: np.ndarray, times: np.ndarray) -> bytes:
    """Rising numbers as steps, then counts, of 32 bits each, first bytes first: most of the rest is zero and compresses."""
    both = np.empty((2, len(number)), "<u4")
    both[0], both[1] = number, times
    both[0, 1:] -= both[0, :-1].copy()
    return both.view(np.uint8).reshape(2, len(number), 4).transpose(0, 2, 1).tobytes()


def unpacked(data: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(data, np.uint8)
    both = np.ascontiguousarray(flat.reshape(2, 4, len(flat) // 8).transpose(0, 2, 1)).view("<u4").reshape(2, len(flat) // 8).astype(np.int64)
    return np.cumsum(both[0]), both[1]


class Tokenizers:
    """Both files, read on the driver and made available to the workers once; their size is that of the files."""

    def __init__(self, spark: SparkSession, a_path: str, b_path: str):
        a, b = Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes()
        json.loads(a)
        self.shared = spark.sparkContext.broadcast((a, b))
        self.name = hashlib.md5(a.encode() + b).hexdigest()

    def pair(self) -> Pair:
        return common.kept("pair", self.name, lambda: Pair(*self.shared.value))


_PER_DOCUMENT = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "counts": pa.binary()}
_PER_PAIR = {"at": pa.int32(), "pair": pa.int64(), "times": pa.int64()}
_ROW = "block long, at int, pair long, times long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, counts binary"


def _block(pair: Pair, texts: Iterable[str | None]) -> Iterator[dict[str, list | np.ndarray]]:
    """The rows of a block in parts: of its documents, in their order, then of its distinct token pairs."""
    numbers = _Ids()
    held = [np.fromiter(map(numbers.__getitem__, pair.units(t)), np.int32) if t else np.empty(0, np.int32) for t in texts]
    words = list(numbers)
    del numbers
    units = Units(pair, words)
    times = np.zeros(len(units.pairs), np.int64)
    out, size = {n: [] for n in _PER_DOCUMENT}, 0
    for of in held:
        if len(of) and not units.fits[of].all():
            of = of[:0]
        for name in ("n_a", "n_b", "n_groups", "n_links"):
            out[name].append(int(getattr(units, name)[of].sum()))
        said = ";".join(map(units.text.__getitem__, of.tolist()))
        out["groups_sha256"].append(hashlib.sha256(said.encode()).hexdigest() if len(of) else "")
        number, n = units.counted(of)
        times[number] += n
        out["counts"].append(packed(number, n))
        size += len(out["counts"][-1])
        if size > _COUNT_BYTES:
            yield out
            out, size = {n: [] for n in _PER_DOCUMENT}, 0
    if out["n_a"]:
        yield out
    # Pairs that only occur in texts without tokens are left out; no document asks for them.
    used = np.flatnonzero(times)
    for i in range(0, len(used), _PAIRS):
        at = used[i : i + _PAIRS]
        yield {"at": at, "pair": units.pairs[at], "times": times[at]}


def blocks(docs: DataFrame, tokenizers: Tokenizers, text: str, columns: list[str], size: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and one per block and distinct pair (its number in ``at``); ``c0, c1, ..`` hold the ``columns``."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(text).alias("_text"))
    names = ["block", *_PER_PAIR, *_PER_DOCUMENT, *[f"c{i}" for i in range(len(columns))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers.pair()

        def made(parts: list[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
            whole, begin = pa.Table.from_batches(parts), 0
            for found in _block(pair, (t.as_py() for t in whole.column(len(columns)))):
                n, of_docs = len(found["at" if "at" in found else "n_a"]), "at" not in found
                values = {k: pa.array(found[k], kind) if k in found else pa.nulls(n, kind) for k, kind in (_PER_PAIR | _PER_DOCUMENT).items()}
                kept = [whole.column(i).slice(begin, n).combine_chunks() if of_docs else pa.nulls(n, whole.schema.field(i).type) for i in range(len(columns))]
                begin += n * of_docs
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *values.values(), *kept], names=names)
            common.give_back()

        parts, held, block = [], 0, 0
        for batch in batches:
            for part in common.slices(batch, size):
                upto = sum(b.as_py() or 0 for b in pa.compute.binary_length(part.column(len(columns))))
                if parts and held + upto > size:
                    yield from made(parts, block)
                    parts, held, block = [], 0, block + 1
                parts.append(part)
                held += upto
        if parts:
            yield from made(parts, block)

    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(run, _ROW + kinds)
    return out.withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("block"))


def pair_counts(written: DataFrame) -> DataFrame:
    """``pair, n, best``: links of every id pair (A id in the upper half) and whether no pair of its B id has more.

    A B id has at most as many pairs as A has ids, so its window is bounded by the vocabulary.
    """
    summed = written.filter("at is not null").groupBy("pair").agg(F.sum("times").alias("n"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return summed.withColumn("best", F.col("n") == F.max("n").over(of_b))


def align(docs: DataFrame, tokenizers: Tokenizers, text: str = "text", columns: list[str] | None = None, size: int = BLOCK_BYTES) -> DataFrame:
    """``columns`` of ``docs`` (default: all but the text) with token, group and link counts and the printed groups' hash.

    ``n_links`` counts the pairs of overlapping tokens, ``count_sum`` adds up how many links of the whole table
    join each one's ids, ``n_best`` counts those for which no other A id is linked to the B id more often.
    """
    asked = [c for c in (columns if columns is not None else docs.columns) if c != text]
    carried = common.without(docs.select(*[F.col(f"`{c}`") for c in asked]), _ADDED).columns
    kinds = {f"c{i}": docs.schema[c].dataType for i, c in enumerate(carried)}
    written = settle(blocks(docs, tokenizers, text, carried, size)).df
    counted = settle(pair_counts(written))
    of_pair = common.join_checked(written.filter("at is not null").select("block", "at", "pair"), counted, ["pair"])
    names = [*kinds, *list(_PER_DOCUMENT)[:-1]]
    of_docs = written.filter("at is null").select("block", *names, "counts")
    told = of_docs.unionByName(of_pair.drop("pair"), allowMissingColumns=True)
    # A block is whole in one task: first its pairs, then its documents.
    told = told.repartition("block").sortWithinPartitions("block", F.asc_nulls_last("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker that made blocks does not need the tokenizers any more.
        common.kept("pair", "", lambda: None)
        common.give_back()
        block, held = None, []
        sums = bests = np.zeros(0, np.int64)
        for batch in batches:
            of, paired = batch.column("block").to_numpy(), batch.column("at").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (paired[1:] != paired[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if of[begin] != block:
                    block, held = of[begin], []
                    sums = bests = np.zeros(0, np.int64)
                if paired[begin]:
                    held.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "best")])
                    continue
                if held:
                    at, n, best = map(np.concatenate, zip(*held))
                    held = []
                    sums, bests = (np.zeros(at.max() + 1, np.int64) for _ in range(2))
                    sums[at], bests[at] = n, best
                made = []
                for data in part.column("counts"):
                    number, times = unpacked(data.as_buffer())
                    made.append((int(bests[number] @ times), int(sums[number] @ times)))
                added = [pa.array(m, pa.int64()) for m in zip(*made)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *added], names=[*names, "n_best", "count_sum"])

    schema = T.StructType([T.StructField(c, k) for c, k in kinds.items()])
    schema = schema.add("n_a", "long").add("n_b", "long").add("n_groups", "long").add("n_links", "long").add("groups_sha256", "string")
    out = told.mapInArrow(run, schema.add("n_best", "long").add("count_sum", "long"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], *_ADDED)
