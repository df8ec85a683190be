"""Where inside a flagged window the anomaly sits.

Every window is one array on one row, so all of it is row-local: one pandas UDF over the
error vectors, running sums and first-wins maxima in NumPy, no shuffle and no join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import GridSpec, LocaliseSpec

# Equal moving sums may differ in their last bits; ties are decided at this precision.
TIE_DIGITS = 9
_SCALE = "struct<hours:int,t_star:int,t_end:int,peak_score:double,mean_score:double,contrast_ratio:double,window_samples:int>"
_FOUND = f"struct<scales:array<{_SCALE}>,span_start:int,above:int,has_spike:boolean>"


def fitting_scales(spec: LocaliseSpec, length: int) -> list[int]:
    fitting = [h for h in spec.scales_hours if h * spec.per_hour <= length]
    if not fitting:
        raise ValueError("no localisation scale fits the window length")
    return fitting


def report_scale(spec: LocaliseSpec, length: int) -> int:
    fitting = fitting_scales(spec, length)
    return spec.report_hours if spec.report_hours in fitting else min(fitting)


def _moving(x: np.ndarray, width: int) -> np.ndarray:
    """Sums over ``width`` neighbours per row, from one running sum."""
    upto = np.cumsum(x, axis=1)
    return upto[:, width - 1 :] - (upto[:, : x.shape[1] - width + 1] - x[:, : x.shape[1] - width + 1])


def _locate(x: np.ndarray, spec: LocaliseSpec) -> list[dict]:
    """Largest sub-window per scale and the reported span, for windows of one length (missing points count 0)."""
    x = np.nan_to_num(x)
    n, length = x.shape
    scales: list[list[dict]] = [[] for _ in range(n)]
    for hours in fitting_scales(spec, length):
        width = hours * spec.per_hour
        total = _moving(x, width)
        at = np.round(total, TIE_DIGITS).argmax(axis=1)
        peak, mean = total[np.arange(n), at], total.mean(axis=1)
        for i in range(n):
            scales[i].append(
                {
                    "hours": hours,
                    "t_star": int(at[i]),
                    "t_end": int(at[i]) + width - 1,
                    "peak_score": float(peak[i]),
                    "mean_score": float(mean[i]),
                    "contrast_ratio": float(peak[i] / mean[i]) if mean[i] > 0 else 0.0,
                    "window_samples": width,
                }
            )
    # Spike first, then the count above the error level, then the earliest.
    width = report_scale(spec, length) * spec.per_hour
    frames = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)
    mean, most = frames.mean(axis=2), frames.max(axis=2)
    spike = (mean > 0) & (most >= spec.spike_multiple * mean)
    above = (frames > spec.error_level).sum(axis=2)
    at = (spike * (width + 1) + above).argmax(axis=1)
    return [
        {"scales": scales[i], "span_start": int(at[i]), "above": int(above[i, at[i]]), "has_spike": bool(spike[i, at[i]])}
        for i in range(n)
    ]


def found_in(err: Column, spec: LocaliseSpec) -> Column:
    """All scales and the span of an error vector; null for a null vector."""

    @F.pandas_udf(_FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[dict] = [{"scales": None, "span_start": None, "above": None, "has_spike": None}] * len(batch)
            lengths = np.array([-1 if v is None else len(v) for v in batch])
            for length in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == length)
                for i, found in zip(rows, _locate(np.stack(batch.iloc[rows].to_numpy()).astype(float), spec)):
                    out[i] = found
            frame = pd.DataFrame(out)
            yield frame.astype({"span_start": "Int32", "above": "Int32", "has_spike": "boolean"})

    return run(err)


def located(scored: DataFrame, grid: GridSpec, spec: LocaliseSpec = LocaliseSpec()) -> DataFrame:
    """``scored`` with ``_place``: where its flagged windows (``is_flagged``, ``err``) have their anomaly."""
    hours = report_scale(spec, grid.length)
    width = hours * spec.per_hour
    rows = scored.withColumn("_found", found_in(F.when(F.col("is_flagged"), F.col("err")), spec))
    first = F.col("_found.span_start")
    end = F.least(first + (width - 1), F.lit(grid.length - 1))
    start = F.unix_seconds("start_ts")
    detail = F.map_from_entries(
        F.transform(
            "_found.scales",
            lambda x: F.struct(
                x["hours"],
                F.struct(*[x[n].alias(n) for n in ("t_star", "t_end", "peak_score", "mean_score", "contrast_ratio", "window_samples")]),
            ),
        )
    )
    place = F.struct(
        F.timestamp_seconds(start + first * grid.step_seconds).alias("anomaly_start"),
        F.timestamp_seconds(start + end * grid.step_seconds).alias("anomaly_end"),
        first.alias("anomaly_start_idx"),
        end.alias("anomaly_end_idx"),
        F.lit(hours).alias("scale_hours"),
        F.lit(width).alias("scale_samples"),
        F.col("_scales")[hours]["contrast_ratio"].alias("contrast_ratio"),
        F.col("_scales")[hours]["peak_score"].alias("peak_score"),
        F.col("_scales").alias("all_scales"),
    )
    return rows.withColumn("_scales", detail).withColumn("_place", place).drop("_scales", "_found")


def localise(flagged: DataFrame, grid: GridSpec, spec: LocaliseSpec = LocaliseSpec()) -> DataFrame:
    """Localisation of flagged dense windows (``err`` vector), with all scales as a map."""
    rows = flagged.withColumn("is_flagged", F.lit(True)).select("series_id", "window_id", "start_ts", "err", "is_flagged")
    return located(rows, grid, spec).select("series_id", "window_id", "_place.*")


def scale_results(flagged: DataFrame, grid: GridSpec, spec: LocaliseSpec = LocaliseSpec()) -> DataFrame:
    """First position of the largest sum per scale and its contrast to the mean sum: one row per window and scale."""
    found = localise(flagged, grid, spec)
    return found.select("series_id", "window_id", F.explode("all_scales").alias("hours", "_d")).select("series_id", "window_id", "hours", "_d.*")


def top_points(scored: DataFrame, grid: GridSpec, rank_by: str, spec: LocaliseSpec = LocaliseSpec()) -> DataFrame:
    """The ``spec.top`` highest points inside the span of every flagged window, ties to the earlier one.

    Row-local: the span is a slice of the window, at most ``scale_samples`` long.
    """
    placed = (scored if "_place" in scored.columns else located(scored, grid, spec)).filter("is_flagged")
    out = placed.withColumn("_top", F.explode(top_places(rank_by, spec.top))).withColumn("pos", F.col("_top"))
    return out.select(
        "series_id",
        "window_id",
        "pos",
        F.timestamp_seconds(F.unix_seconds("start_ts") + F.col("pos") * grid.step_seconds).alias("ts"),
        F.get("values", F.col("pos")).alias("value"),
        F.get(F.col(rank_by), F.col("pos")).alias("point_score"),
        F.col("window_score").alias("anomaly_score"),
        F.col("_place.anomaly_start").alias("localization_start"),
        F.col("_place.anomaly_end").alias("localization_end"),
        F.col("_place.scale_hours").alias("scale_hours"),
        F.col("_place.contrast_ratio").alias("contrast_ratio"),
    )


def top_places(rank_by: str, n: int) -> Column:
    """Positions of the highest points inside ``_place``, the highest first."""
    place = F.transform(
        F.sequence(F.col("_place.anomaly_start_idx"), F.col("_place.anomaly_end_idx")),
        lambda p: F.struct((-F.get(F.col(rank_by), p)).alias("_neg"), p.alias("pos")),
    )
    return F.transform(F.slice(F.array_sort(place), 1, n), lambda x: x["pos"])
