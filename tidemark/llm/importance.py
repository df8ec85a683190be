"""Importance resampling towards a target distribution, on hashed word n-grams.

A text is lower-cased (A-Z only) and every run of separators becomes one space. One overlapped scan of a
regular expression with boundary lookarounds then yields, at each word, the spans of the runs of one
to ``runs`` words that begin there. The CRC-32 of a span continues that of the shorter one, and its
remainder is the feature's bucket. The buckets of a document are written once, two bytes each;
bucket counts of both tables give every bucket a gain, a document weighs the sum of its gains, and Gumbel
noise from a hash of its id turns weights into a draw without replacement. Ranks come from a range sort.

Null and blank texts have no features and weigh 0. A null id is hashed as empty text; rows of equal score rank by id,
null last, then by their place in the written table. Repeated rows are ranked one by one.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.session import settle

BUCKETS = 10_000
RUNS = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
_SEPARATORS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Words whose spans are held at a time.
_CHUNK = 1 << 16
_ADDED = ["n_words", "n_features", "weight", "score", "rank"]


def spans(runs: int = RUNS) -> regex.Pattern:
    """At a word: group 1 is the word, each further group the next word with its space."""
    more = ""
    for _ in range(runs - 1):
        more = f"(?:( [^ ]+){more})?"
    return regex.compile(f"(?<![^ ])([^ ]+){more}(?![^ ])".encode())


def crcs(text: str | None, scan: regex.Pattern) -> tuple[int, list[np.ndarray]]:
    """Number of words and the CRC-32 of every feature."""
    body = _SEPARATORS.sub(b" ", (text or "").encode("utf-8").lower()).strip(b" ")
    words, found = 0, []
    matches = scan.finditer(body, overlapped=True)
    groups = operator.methodcaller("group", *range(1, scan.groups + 1)) if scan.groups > 1 else lambda m: (m.group(1),)
    while chunk := list(map(groups, islice(matches, _CHUNK))):
        words += len(chunk)
        before = [0] * len(chunk)
        for column in zip(*chunk):
            # A run that would leave the text is missing, at the last words only.
            whole = len(column) - column.count(None)
            before = list(map(crc32, column[:whole], before))
            found.append(np.array(before, dtype=np.uint32))
    return words, found


def features(docs: DataFrame, text: str = "text", columns: list[str] | None = None, buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """``columns`` of ``docs`` with ``n_words, n_features`` and ``buckets`` (one unsigned integer a feature, packed)."""
    kind = _kind(buckets)

    def make(texts: list[str | None]) -> list[pa.Array]:
        scan = spans(runs)
        words, sizes, packed = [], [], []
        for t in texts:
            n, found = crcs(t, scan)
            held = (np.concatenate(found) % buckets).astype(kind) if found else np.empty(0, kind)
            words.append(n)
            sizes.append(len(held))
            packed.append(held.tobytes())
        return [pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]

    return common.map_texts(docs, text, columns or [], make, "n_words long, n_features long, buckets binary")


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket: one partial count a task, summed by Spark; ``buckets`` rows reach the driver."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                held += np.bincount(np.frombuffer(value.as_buffer(), dtype=kind), minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["bucket", "n"])

    counted = packed.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in counted.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the logarithm of its target share over its share in ``rows``, add-one smoothed, in thousandths, floored."""
    size = float(len(rows))
    ratio = (target + 1.0) * (rows.sum() + size) / ((rows + 1.0) * (target.sum() + size))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weighed(packed: DataFrame, gain: np.ndarray, columns: list[str]) -> DataFrame:
    """``columns`` of ``packed`` with ``weight``, the sum of the gains of a row's features."""
    kind = _kind(len(gain))
    common.small_batches(packed.sparkSession)
    rows = packed.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], "buckets")
    names = [*rows.columns[:-1], "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(len(columns))
            sums = [int(gain[np.frombuffer(v.as_buffer(), dtype=kind)].sum()) for v in held]
            kept = [batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.int64())], names=names)

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(run, kinds + "weight long")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "weight")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of the SHA-256 of ``seed:key``."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    columns: list[str] | None = None,
    buckets: int = BUCKETS,
    runs: int = RUNS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """All rows of ``docs``, with ``n_words, n_features, weight, score`` and ``rank`` (null: not drawn).

    Of the N rows with at least ``least_words`` words the ``percent * N // 100`` with the highest scores are drawn, ranked from 1.
    ``columns`` (default: all but the text) are carried; those named like a result are replaced. Both tables may be empty.
    """
    carried = common.without(docs.select(key, *[c for c in (columns or docs.columns) if c not in (key, text)]), [*_ADDED, "buckets", "_row", "_group", "_part", "_at"]).columns
    packed = settle(features(docs, text, carried, buckets, runs)).df
    wanted = settle(features(target, text, [], buckets, runs)).df
    gain = gains(bucket_counts(packed, buckets), bucket_counts(wanted, buckets))
    kept = [*carried, "n_words", "n_features"]
    scored = weighed(packed, gain, kept).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    able = F.col("n_words") >= least_words
    scored = settle(scored.withColumn("_row", F.monotonically_increasing_id()), able=F.count_if(able))
    drawn = percent * (scored.seen["able"] or 0) // 100
    order = [F.when(able, 0).otherwise(1), F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("_row")]
    placed, runs_of = common.placed_in_order(scored.df.withColumn("_group", F.lit(0)), order, "_group")
    rank = F.col("_before") + F.col("_at") - F.col("_first") + 1
    ranked = common.join_checked(placed, runs_of, ["_group", "_part"])
    return ranked.select(*kept, "weight", "score", F.when(rank <= drawn, rank).cast("long").alias("rank"))
