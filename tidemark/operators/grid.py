"""Regular grids and dense windows.

Raw rows are pre-aggregated per (series, time slot) before anything is
shuffled, so a series that holds a third of all rows costs no more than its
number of slots. On a regular grid the position of a row is arithmetic:
``idx = slot - origin``; no sort and no window function is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import GridSpec
from tidemark.session import Sized, attach, settle


def bucket(rows: DataFrame, series: str, ts: str, step_seconds: int, value: Column | None = None) -> DataFrame:
    """Rows to ``(series_id, slot, value)``: a count per slot, or the given aggregate."""
    slot = F.floor(F.unix_seconds(F.col(ts)) / F.lit(step_seconds)).cast("long")
    measure = F.count(F.lit(1)) if value is None else value
    return rows.groupBy(F.col(series).alias("series_id"), slot.alias("slot")).agg(measure.cast("double").alias("value"))


def regular_windows(buckets: DataFrame, spec: GridSpec, fill: float = 0.0, keep_tail: bool = False) -> DataFrame:
    """Dense windows of every series over its own span, gaps filled.

    The bucket table is written once (a small fraction of the raw rows), so the raw
    table is scanned exactly once; first and last slot per series are one row each.
    A series starts at its own first slot plus ``offset_days``. A slot that is there with a
    null value stays null; only absent slots are filled.
    """
    kept = settle(buckets.filter(F.col("series_id").isNotNull() & F.col("slot").isNotNull())).df
    spans = kept.groupBy("series_id").agg((F.min("slot") + spec.offset_slots).alias("_lo"), F.max("slot").alias("_hi"))
    return windows_over(kept, settle(spans), spec, fill, keep_tail)


def windows_over(buckets: DataFrame, spans: Sized, spec: GridSpec, fill: float = 0.0, keep_tail: bool = False) -> DataFrame:
    """As ``regular_windows`` for known spans: ``series_id, _lo, _hi``, both ends inclusive.

    One shuffle on (series, window): the window spine adds empty windows of a
    series' own span, and missing slots inside a window are filled in the array itself.
    """
    length = spec.length
    total = F.greatest(F.lit(0).cast("long"), F.col("_hi") - F.col("_lo") + 1)
    whole = F.floor(total / length).cast("long")
    ends = total if keep_tail else whole * length
    placed = F.col("slot") - F.col("_lo")
    found = attach(buckets, spans, ["series_id"]).filter((placed >= 0) & (placed < ends)).select(
        "series_id",
        F.floor(placed / F.lit(length)).cast("long").alias("window_id"),
        F.struct(F.pmod(placed, F.lit(length)).cast("int").alias("pos"), "value").alias("_cell"),
        F.lit(None).cast("struct<start:bigint,size:int>").alias("_frame"),
    )
    windows = F.ceil(ends / length).cast("long")
    window = F.col("window_id")
    spine = (
        spans.df.filter(ends > 0)
        .withColumn("window_id", F.explode(F.sequence(F.lit(0).cast("long"), windows - 1)))
        .select(
            "series_id",
            "window_id",
            F.lit(None).cast("struct<pos:int,value:double>").alias("_cell"),
            F.struct(
                (F.col("_lo") + window * length).alias("start"), F.least(F.lit(length), total - window * length).cast("int").alias("size")
            ).alias("_frame"),
        )
    )
    packed = (
        found.unionByName(spine)
        .groupBy("series_id", "window_id")
        .agg(F.collect_list("_cell").alias("_cells"), F.first("_frame", ignorenulls=True).alias("_frame"))
        .withColumn("_pos", F.transform("_cells", lambda c: c["pos"]))
    )

    def value(p):
        at = F.array_position("_pos", p).cast("int")
        return F.when(at == 0, F.lit(float(fill))).otherwise(F.get("_cells", at - 1)["value"])

    start = F.col("_frame.start") * spec.step_seconds
    size = F.col("_frame.size")
    return packed.select(
        "series_id",
        "window_id",
        F.timestamp_seconds(start).alias("start_ts"),
        F.timestamp_seconds(start + (size - 1) * spec.step_seconds).alias("end_ts"),
        F.transform(F.sequence(F.lit(0), size - 1), value).alias("values"),
    )


def points(windows: DataFrame, spec: GridSpec, values: str = "values", value: str = "value", keep: tuple = ()) -> DataFrame:
    """Dense windows to long rows; timestamps are regenerated from the window start."""
    return windows.select("series_id", "window_id", "start_ts", *keep, F.posexplode(values).alias("pos", value)).select(
        "series_id",
        "window_id",
        "pos",
        (F.col("window_id") * spec.length + F.col("pos")).alias("idx"),
        F.timestamp_seconds(F.unix_seconds("start_ts") + F.col("pos") * spec.step_seconds).alias("ts"),
        value,
        *keep,
    )


def shared_blocks(rows: DataFrame, block: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Cut long series into blocks and copy border rows to the neighbour block that needs them.

    ``back`` rows before and ``ahead`` rows after every row become visible inside
    its block, so a row-frame window function can be partitioned by
    ``(series_id, block)`` instead of by the whole series. Filter ``is_own`` after it.
    """
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - ahead) / block)).cast("long")
    last = F.floor((F.col("idx") + back) / block).cast("long")
    return rows.withColumn("block", F.explode(F.sequence(first, last))).withColumn(
        "is_own", F.col("block") == F.floor(F.col("idx") / block).cast("long")
    )
