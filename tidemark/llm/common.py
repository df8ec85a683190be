"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import Sized, settle

# A word is a run of characters that are not ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
BLANK = "[\\x20\\x09-\\x0D]+"
# A table is broadcast only when its measured size stays below this bound.
BROADCAST_BYTES = 32 * 1024 * 1024
# Text that a Python worker handles at a time.
SLICE_BYTES = 4 * 1024 * 1024


def kept(kind: str, key: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, kept in this process for the next tasks until another ``key`` of its kind is asked for.

    Task functions travel by value, and their module's variables with them; a worker keeps nothing in those.
    """
    held = sys.__dict__.setdefault("_kept_for_tasks", {})
    if kind not in held or held[kind][0] != key:
        held.pop(kind, None)
        held[kind] = (key, make())
    return held[kind][1]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns whose names an operator is about to use; names compare without case, as Spark does."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def null_safe(column: Column) -> Column:
    """A join key without nulls: null and every text get different keys."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), column.cast("string")))


def join_checked(rows: DataFrame, small: Sized, on: list[str], how: str = "inner") -> DataFrame:
    """Join a table of measured size: broadcast below the bound, a shuffle join (with adaptive skew handling) above."""
    right = F.broadcast(small.df) if small.bytes <= BROADCAST_BYTES else small.df
    return rows.join(right, on, how)


def placed_in_order(rows: DataFrame, order: list[Column | str], group: str) -> tuple[DataFrame, Sized]:
    """Write ``rows`` range-partitioned and sorted by (group, order); a hot group spreads over many tasks.

    Returns the written rows with ``_part`` (the range partition) and ``_at`` (a number
    that rises by one from row to row of a partition), and per (group, ``_part``) the first
    ``_at``, the row count ``_n`` and the rows ``_before`` it in the group. That second table
    has at most (partitions + groups) rows.
    """
    from pyspark.sql import Window

    placed = (
        rows.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    written = settle(placed).df
    runs = written.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return written, settle(runs)


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by the bytes of its last column; a longer text makes a slice of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + size, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def size_in_bytes(text: str) -> int:
    """A size as Spark's settings write it: bytes, or with a unit such as ``64m`` or ``64MB``."""
    number, unit = re.fullmatch("(-?[0-9]+)([a-z]*)", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index((unit.rstrip("b") or " ")[0])


def small_batches(spark: SparkSession) -> None:
    """Bound what goes to a Python worker at a time; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if size_in_bytes(spark.conf.get(name)) > SLICE_BYTES:
        spark.conf.set(name, str(SLICE_BYTES))


def give_back() -> None:
    """Return what Arrow and the C library hold of finished batches: a worker serves many stages, and its free memory is no one else's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_texts(
    docs: DataFrame,
    text: str,
    columns: list[str],
    make: Callable[[list[str | None]], list[pa.Array]],
    added: str,
    size: int = SLICE_BYTES,
) -> DataFrame:
    """``columns`` of ``docs`` and what ``make`` returns for the texts of a slice (``added`` is its schema).

    Other columns pass through as Arrow buffers. A batch is bounded by ``small_batches`` and handled
    in slices of about ``size`` bytes of text, so a worker holds the results of one slice.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(text).alias("_text"))
    names = [f.name for f in T.StructType.fromDDL(added).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size):
                made = make(part.column(part.num_columns - 1).to_pylist())
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[f"c{i}" for i in range(len(kept))] + names)
            give_back()

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(run, kinds + added)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], *names)
