"""Labels by interval overlap, edge cases, ordered splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import fixed_values as fv
from tidemark.config import GridSpec, SplitSpec
from tidemark.session import attach, attach_scalar, settle

# Up to this many intervals are tested inside each row, without a join.
INLINE_INTERVALS = 1000


def label_table(spark: SparkSession, intervals=fv.LABEL_INTERVALS) -> DataFrame:
    rows = [(a, b, name) for a, b, name in intervals]
    return spark.createDataFrame(rows, "start string, end string, name string").select(
        F.to_timestamp("start").alias("start"), F.to_timestamp("end").alias("end"), "name"
    )


def flag_overlap(
    windows: DataFrame, labels: DataFrame | list, spec: GridSpec, min_fraction: float = 0.10, inline_limit: int = INLINE_INTERVALS
) -> DataFrame:
    """``is_anomaly``: some single interval covers at least ``min_fraction`` of the window.

    ``labels`` is a list of ``(start, end, ...)`` texts or a table ``start, end``. Intervals
    with a null end or with ends in the wrong order are left out, whatever the path.
    A list, or a table measured to be short, becomes one array tested in place. A
    long table is cut into time bins: both sides meet on the bin in a
    semi join, which yields a window at most once and never lists pairs.
    """
    ws, we = F.unix_seconds("start_ts"), F.unix_seconds("end_ts")

    def covered(ls, le, ws, we):
        samples = F.floor((F.least(le, we) - F.greatest(ls, ws)) / spec.step_seconds) + 1
        return (ls <= le) & (ws <= le) & (we >= ls) & (samples / spec.length >= F.lit(min_fraction))

    def flagged(listed):
        return F.coalesce(F.exists(listed, lambda x: covered(x["ls"], x["le"], ws, we)), F.lit(False))

    if isinstance(labels, list):
        ends = [[F.unix_seconds(F.to_timestamp(F.lit(t))) for t in row[:2]] for row in labels]
        if not ends:
            return windows.withColumn("is_anomaly", F.lit(False))
        return windows.withColumn("is_anomaly", flagged(F.array(*[F.struct(a.alias("ls"), b.alias("le")) for a, b in ends])))
    ends = labels.select(F.unix_seconds("start").alias("ls"), F.unix_seconds("end").alias("le"))
    fixed = settle(ends.filter(F.col("ls") <= F.col("le")).distinct())
    if fixed.rows <= inline_limit:
        listed = fixed.df.agg(F.collect_list(F.struct("ls", "le")).alias("_labels"))
        return attach_scalar(windows, listed).withColumn("is_anomaly", flagged("_labels")).drop("_labels")
    return _flag_by_bins(windows, fixed.df, spec, covered)


def _flag_by_bins(windows: DataFrame, intervals: DataFrame, spec: GridSpec, covered) -> DataFrame:
    """Bins come in sizes that double: an interval takes the first size not below its length.

    So it lies in two bins at most, however long it is, and a window asks one or two bins of each
    size in use (64 at the very most).
    """
    width = spec.length * spec.step_seconds
    sized = intervals.withColumn(
        "level", F.greatest(F.lit(0), F.ceil(F.log2((F.col("le") - F.col("ls") + 1) / width))).cast("int")
    )
    levels = sorted(r["level"] for r in sized.select("level").distinct().collect())
    if not levels:
        return windows.withColumn("is_anomaly", F.lit(False))

    def bins(a, b):
        size = F.pow(F.lit(2.0), F.col("level")) * width
        return F.explode(F.sequence(F.floor(F.col(a) / size).cast("long"), F.floor(F.col(b) / size).cast("long")))

    left = windows.select("series_id", "window_id", F.unix_seconds("start_ts").alias("ws"), F.unix_seconds("end_ts").alias("we"))
    left = left.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("bin", bins("ws", "we"))
    right = sized.withColumn("bin", bins("ls", "le"))
    meets = (left.bin == right.bin) & (left.level == right.level) & covered(right.ls, right.le, left.ws, left.we)
    hits = left.join(right, meets, "left_semi").select("series_id", "window_id").distinct()
    hits = hits.withColumn("_hit", F.lit(True))
    return (
        windows.join(hits, ["series_id", "window_id"], "left")
        .withColumn("is_anomaly", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def flag_edge_cases(windows: DataFrame, starts=tuple(fv.EDGE_CASE_STARTS)) -> DataFrame:
    return windows.withColumn("is_edge_case", F.date_format("start_ts", "yyyy-MM-dd").isin(list(starts)))


def assign_splits(windows: DataFrame, spec: SplitSpec) -> DataFrame:
    """Ordered split: the first normal windows go to train, val, threshold; the rest and all anomalies to test.

    Only ``spec.used`` windows per series are ever ranked together: the rank
    filter becomes a per-task group limit ahead of the shuffle. Adds ``split``,
    ``split_rank`` (0..3) and ``order_id``, the position in train | val |
    threshold | test order, which is closed-form for the open-ended test part.
    """
    in_time = Window.partitionBy("series_id").orderBy("window_id")
    early = (
        windows.filter(~F.col("is_anomaly"))
        .select("series_id", "window_id", F.row_number().over(in_time).alias("rn"))
        .filter(F.col("rn") <= spec.used)
    )
    used = early.groupBy("series_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "window_id"))), lambda x: x["window_id"]).alias("_used")
    )
    out = attach(windows, used, ["series_id"], "left")
    out = out.withColumn("_used", F.coalesce("_used", F.expr("cast(array() as array<bigint>)")))
    out = out.withColumn("_rank", F.array_position("_used", F.col("window_id")))
    rank = F.col("_rank")
    place = (
        F.when(rank == 0, 3).when(rank <= spec.train, 0).when(rank <= spec.train + spec.val, 1).otherwise(2)
    )
    below = F.size(F.filter("_used", lambda u: u < F.col("window_id")))
    order = F.when(rank == 0, F.size("_used") + F.col("window_id") - below).otherwise(rank - 1)
    names = F.array(F.lit("train"), F.lit("val"), F.lit("threshold"), F.lit("test"))
    return (
        out.withColumn("split_rank", place)
        .withColumn("split", F.get(names, F.col("split_rank")))
        .withColumn("order_id", order.cast("long"))
        .drop("_used", "_rank")
    )
