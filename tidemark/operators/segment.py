"""Count windows over rows in arrival or time order, and sliding windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import attach, settle


def offset_start(rows: DataFrame, offset_days: int) -> DataFrame:
    """Keep rows at or after the first timestamp of the series plus ``offset_days``.

    The first timestamps are one partial aggregate per series; the join is left
    to Catalyst and is salted by the row's own time so a hot series is split.
    """
    first = rows.groupBy("series_id").agg(F.min("ts").alias("_first"))
    return (
        attach(rows, first, ["series_id"])
        .filter(F.col("ts") >= F.col("_first") + F.make_dt_interval(F.lit(offset_days)))
        .drop("_first")
    )


def dense_index(rows: DataFrame, order: list[str], key: str = "series_id") -> DataFrame:
    """Add ``idx`` (0-based position in ``order`` inside the series) and ``total``.

    Rows are range-partitioned on (series, order), so one hot series spreads over
    many tasks. The placement is written once, which fixes it for both passes:
    run lengths per partition give the offsets, a running number gives the rest.
    ``order`` must end in a unique column.
    """
    placed = (
        rows.repartitionByRange(key, *order)
        .sortWithinPartitions(key, *order)
        .withColumn("_run", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = settle(placed).df
    runs = placed.groupBy(key, "_run").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    in_order = Window.partitionBy(key).orderBy("_run")
    offsets = runs.select(
        key,
        "_run",
        "_first",
        (F.sum("_n").over(in_order) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(key)).alias("total"),
    )
    return (
        attach(placed, offsets, [key, "_run"])
        .withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before"))
        .drop("_run", "_at", "_first", "_before")
    )


def count_windows(indexed: DataFrame, length: int, keep_tail: bool = False) -> DataFrame:
    """``window_id`` and ``pos`` by row position; the incomplete tail is dropped."""
    cut = indexed.withColumn("window_id", F.floor(F.col("idx") / length).cast("long")).withColumn(
        "pos", F.pmod("idx", F.lit(length)).cast("int")
    )
    if keep_tail:
        return cut
    return cut.filter(F.col("window_id") < F.floor(F.col("total") / length))


def pack(rows: DataFrame, *names: str) -> DataFrame:
    """Long windows to dense vectors in position order (at most one window per group)."""
    packed = rows.groupBy("series_id", "window_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", *names))).alias("_rows"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
    )
    plural = {"value": "values", "ts": "stamps"}
    vectors = [F.col("_rows").getField(n).alias(plural.get(n, n)) for n in names]
    return packed.select("series_id", "window_id", "start_ts", "end_ts", *vectors)


def window_metadata(rows: DataFrame) -> DataFrame:
    """First / last timestamp, name, mean and population deviation of long windows."""
    return rows.groupBy("series_id", "window_id").agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("name"),
        F.avg("value").alias("mean_value"),
        F.stddev_pop("value").alias("std_value"),
    )


def with_metadata(windows: DataFrame) -> DataFrame:
    """The same metadata for dense windows, row-local."""
    n = F.size("values")
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / n
    out = windows.withColumn("name", F.date_format("start_ts", "yyyy-MM-dd")).withColumn("mean_value", mean)
    spread = F.aggregate("values", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("mean_value"), 2)) / n
    return out.withColumn("std_value", F.sqrt(spread))


def sliding_windows(
    packed: DataFrame, length: int, gate: Callable[[Column], Column] | None = None, with_values: bool = True
) -> DataFrame:
    """All windows of ``length`` rows with step 1, from vectors that include the tail.

    Each block is joined to its successor on (series, window), every start inside
    the block is a slice of the pair. ``gate`` looks at the start timestamp and is
    applied before any vector is cut, so only kept starts pay for their values.
    """
    following = packed.select(
        "series_id",
        (F.col("window_id") - 1).alias("window_id"),
        F.col("stamps").alias("_stamps"),
        F.col("values").alias("_values"),
    )
    pair = packed.join(following, ["series_id", "window_id"], "left")
    pair = pair.select(
        "series_id",
        "window_id",
        F.concat("stamps", F.coalesce("_stamps", F.expr("cast(array() as array<timestamp>)"))).alias("stamps"),
        F.concat("values", F.coalesce("_values", F.expr("cast(array() as array<double>)"))).alias("values"),
        F.size("values").alias("_own"),
    )
    last = F.least(F.col("_own"), F.size("stamps") - (length - 1))
    places = F.filter(F.sequence(F.lit(0), F.lit(length - 1)), lambda p: p < last)
    pair = pair.withColumn("_places", places)
    if gate is not None:
        pair = pair.withColumn("_places", F.filter("_places", lambda p: gate(F.get("stamps", p))))
    # The outer form keeps Spark from testing the (costly) place list a second time ahead of the explode.
    started = pair.withColumn("pos", F.explode_outer("_places")).filter(F.col("pos").isNotNull())
    out = [
        "series_id",
        (F.col("window_id") * length + F.col("pos")).alias("start_idx"),
        F.get("stamps", F.col("pos")).alias("start_ts"),
        F.get("stamps", F.col("pos") + (length - 1)).alias("end_ts"),
    ]
    if with_values:
        out.append(F.slice("values", F.col("pos") + 1, F.lit(length)).alias("values"))
    return started.select(*out)
