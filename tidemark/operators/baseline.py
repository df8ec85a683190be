"""Analytic functions along a long series, and the smoothing baseline.

A series is cut into blocks, with border rows shared between neighbours, so no
window function is ever partitioned by the series alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.grid import shared_blocks

BLOCK = 4096


def _in_block(key: str = "series_id"):
    return Window.partitionBy(key, "block").orderBy("idx")


def one_step_forecast(rows: DataFrame, smoothed: str = "value", value: str = "value", block: int = BLOCK) -> DataFrame:
    """Forecast = previous row's smoothed value; the first row uses its own value."""
    shared = shared_blocks(rows, block, back=1)
    ahead = F.coalesce(F.lag(smoothed, 1).over(_in_block()), F.col(value))
    return shared.withColumn("forecast", ahead).filter("is_own").drop("block", "is_own")


def rolling_features(rows: DataFrame, width: int = 10, block: int = BLOCK) -> DataFrame:
    """Rolling mean and deviation over the last ``width`` rows, distance to the mean, first difference."""
    shared = shared_blocks(rows, block, back=width - 1)
    frame = _in_block().rowsBetween(-(width - 1), 0)
    return (
        shared.withColumn("rolling_mean", F.avg("value").over(frame))
        .withColumn("rolling_std", F.stddev("value").over(frame))
        .withColumn("deviation", F.abs(F.col("value") - F.col("rolling_mean")))
        .withColumn("diff", F.col("value") - F.lag("value", 1).over(_in_block()))
        .filter("is_own")
        .drop("block", "is_own")
    )


def moving_stats(rows: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """Sum, mean and maximum of the ``width`` rows from each row on (full frames only)."""
    shared = shared_blocks(rows, block, ahead=width - 1)
    frame = _in_block().rowsBetween(0, width - 1)
    return (
        shared.withColumn("moving_sum", F.sum("value").over(frame))
        .withColumn("moving_mean", F.avg("value").over(frame))
        .withColumn("moving_max", F.max("value").over(frame))
        .withColumn("_n", F.count(F.lit(1)).over(frame))
        .filter((F.col("_n") == width) & F.col("is_own"))
        .drop("block", "is_own", "_n")
    )


def prefix_sum(rows: DataFrame, value: str = "value", block: int = BLOCK) -> DataFrame:
    """Running sum along the series: inside blocks, plus the totals of the blocks before.

    The block totals are summed up in two levels as well: blocks inside groups of ``block`` blocks, then
    the groups, so that one series of n rows puts n / block^2 rows into one task.
    """
    cut = rows.withColumn("block", F.floor(F.col("idx") / block).cast("long"))
    totals = cut.groupBy("series_id", "block").agg(F.sum(value).alias("_total"))
    totals = totals.withColumn("_group", F.floor(F.col("block") / block).cast("long"))
    groups = totals.groupBy("series_id", "_group").agg(F.sum("_total").alias("_sum"))
    earlier = Window.partitionBy("series_id").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("series_id", "_group", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_base"))
    before = Window.partitionBy("series_id", "_group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.join(groups, ["series_id", "_group"]).select(
        "series_id", "block", (F.col("_base") + F.coalesce(F.sum("_total").over(before), F.lit(0.0))).alias("_carry")
    )
    local = cut.withColumn("_local", F.sum(value).over(_in_block()))
    return (
        local.join(carry, ["series_id", "block"])
        .withColumn("running_sum", F.col("_local") + F.col("_carry"))
        .drop("block", "_local", "_carry")
    )


def exponential_smoothing(rows: DataFrame, span: int = 48, value: str = "value", block: int = 336) -> DataFrame:
    """Adjusted exponential smoothing ``sum r^i x[t-i] / sum r^i``, ``r = 1 - 2 / (span + 1)``.

    Two levels: a running sum with exponents relative to the block start, and a
    carry from the few blocks before that still weigh anything in double precision.
    """
    r = 1.0 - 2.0 / (span + 1.0)
    log_r = math.log(r)
    reach = max(1, math.ceil(37.0 / (block * -log_r)))
    if block * -log_r > 600:
        raise ValueError("block is too long for this span")
    cut = rows.withColumn("block", F.floor(F.col("idx") / block).cast("long")).withColumn(
        "_at", F.pmod("idx", F.lit(block))
    )
    # r^(B-1-at) x summed over a block: its weight as seen from the block's last row.
    totals = cut.groupBy("series_id", "block").agg(
        F.sum(F.col(value) * F.exp(F.lit(log_r) * (block - 1 - F.col("_at")))).alias("_total")
    )
    # Every block total is handed on to the next `reach` blocks: an explode, no long window.
    handed = totals.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    carry = handed.groupBy("series_id", (F.col("block") + F.col("_step")).alias("block")).agg(
        F.sum(F.col("_total") * F.exp(F.lit(log_r * block) * (F.col("_step") - 1))).alias("_carry")
    )
    running = F.sum(F.col(value) * F.exp(F.lit(-log_r) * F.col("_at"))).over(_in_block())
    local = cut.withColumn("_local", running * F.exp(F.lit(log_r) * F.col("_at")))
    joined = local.join(carry, ["series_id", "block"], "left")
    num = F.col("_local") + F.coalesce(F.col("_carry") * F.exp(F.lit(log_r) * (F.col("_at") + 1)), F.lit(0.0))
    den = (1.0 - F.exp(F.lit(log_r) * (F.col("idx") + 1))) / (1.0 - r)
    return joined.withColumn("smoothed", num / den).drop("block", "_at", "_local", "_carry")


def ordered_series(windows: DataFrame, length: int, values: str = "values") -> DataFrame:
    """train | val | threshold | test windows as one series with a new ``idx``."""
    return windows.select(
        "series_id", "window_id", "split", "is_anomaly", "order_id", F.posexplode(values).alias("pos", "value")
    ).withColumn("idx", F.col("order_id") * length + F.col("pos"))


def smoothing_scores(windows: DataFrame, length: int, span: int = 48, values: str = "values") -> DataFrame:
    """Mean squared one-step forecast error of every test window, ``score``."""
    smooth = exponential_smoothing(ordered_series(windows, length, values), span)
    ahead = one_step_forecast(smooth, "smoothed")
    return (
        ahead.filter(F.col("split") == "test")
        .groupBy("series_id", "window_id", "is_anomaly")
        .agg(F.avg(F.pow(F.col("value") - F.col("forecast"), 2)).alias("score"))
    )


def autocorrelation(rows: DataFrame, max_lag: int, block: int | None = None) -> DataFrame:
    """``sum (x_t - m)(x_{t+l} - m) / sum (x - m)^2`` for all lags below ``max_lag``.

    Blocks carry a halo of ``max_lag`` rows and reduce to one partial sum per lag,
    so rows are not multiplied by the number of lags.
    """
    from tidemark.session import attach

    block = block or max(BLOCK, max_lag)
    stats = rows.groupBy("series_id").agg(F.avg("value").alias("_m"), F.var_pop("value").alias("_v"), F.count("value").alias("_n"))
    centred = attach(rows.select("series_id", "idx", "value"), stats, ["series_id"])
    centred = centred.withColumn("value", F.col("value") - F.col("_m"))
    shared = shared_blocks(centred, block, ahead=max_lag - 1)
    packed = shared.groupBy("series_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_rows"),
        F.count_if("is_own").alias("own"),
        F.first("_v").alias("_v"),
        F.first("_n").alias("_n"),
    )
    packed = packed.withColumn("x", F.transform("_rows", lambda r: r["value"])).drop("_rows")

    @F.pandas_udf("array<double>")
    def lag_sums(x: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for vec, n in zip(x, own):
            padded = np.concatenate([np.asarray(vec, dtype=float), np.zeros(max_lag)])
            shifted = np.lib.stride_tricks.sliding_window_view(padded, max_lag)[:n]
            out.append(padded[:n] @ shifted)
        return pd.Series(out)

    parts = packed.select("series_id", "_v", "_n", F.posexplode(lag_sums("x", "own")).alias("lag", "_part"))
    sums = parts.groupBy("series_id", "lag").agg(F.sum("_part").alias("_sum"), F.first("_v").alias("_v"), F.first("_n").alias("_n"))
    return sums.select("series_id", "lag", (F.col("_sum") / (F.col("_v") * F.col("_n"))).alias("acf"))
