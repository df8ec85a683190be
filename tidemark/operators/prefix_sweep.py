"""Sweeps over splits with the seasonal profile, read off prefix moments.

The development windows of a series are ranked once. A trial trains on the first
``train`` of them, fits the error distribution on the next ``val`` and takes its
threshold from the ``threshold`` after those, so everything a trial needs is a
prefix: the scaler and the profile are running moments of the values, the error
mean is a running sum of the error vectors behind ``train``, and the window
covariance of ``val`` windows is a leading block of one Gram matrix. Trials with
the same ``train`` share their error vectors.

Every window is scored once, for all trials together, and no window is copied
for a trial.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import ScorerSpec
from tidemark.session import Sized, attach, settle

# Windows of one series that meet their fits in one row.
BLOCK = 256

_FITS = (
    "train int, mean double, scale double, profile array<double>, pivot array<double>, rows array<array<double>>,"
    " trials array<int>, vals array<int>, limits array<double>, mus array<double>, variances array<double>"
)


def running_moments(x: np.ndarray) -> np.ndarray:
    """Count, mean and summed squared deviation of all values in the first k rows, for k from 0.

    Moments are merged row by row, which keeps the digits that a difference of
    plain sums of squares would lose. Missing values do not count.
    """
    out = np.zeros((len(x) + 1, 3))
    for k, row in enumerate(x):
        count, centre, squares = out[k]
        row = row[~np.isnan(row)]
        if not len(row):
            out[k + 1] = out[k]
            continue
        mean = row[0] + (row - row[0]).mean()
        spread, step, total = ((row - mean) ** 2).sum(), mean - centre, count + len(row)
        out[k + 1] = total, centre + step * len(row) / total, squares + spread + step * step * count * len(row) / total
    return out


def prefix_scores(gram: np.ndarray, along: np.ndarray, lengths: np.ndarray, val: int, ridge: float) -> np.ndarray:
    """Squared Mahalanobis distances under the first ``val`` fit rows, from inner products alone.

    ``gram`` holds the products of the fit rows, ``along`` those of the scored
    rows with them and ``lengths`` the scored rows' squared lengths, all about one
    pivot; centring on the mean of the prefix happens on the products.
    """
    k, g = gram[:val, :val], along[:, :val]
    k_mean, g_mean = k.mean(axis=1), g.mean(axis=1)
    whole = k_mean.mean()
    centred = k - k_mean[:, None] - k_mean[None, :] + whole
    seen = g - g_mean[:, None] - k_mean + whole
    inside = np.linalg.solve(centred + (val - 1) * ridge * np.eye(val), seen.T).T
    return (lengths - 2 * g_mean + whole - (seen * inside).sum(axis=1)) / ridge


def _fits_of(dev: np.ndarray, trials: list[dict], scorer: ScorerSpec) -> list[dict]:
    """One record per distinct ``train`` of the trials that this series has windows for."""
    have, out = len(dev), []
    moments = running_moments(dev)
    sums, counts = np.cumsum(np.nan_to_num(dev), axis=0), np.cumsum(~np.isnan(dev), axis=0)
    fewest = 2 if scorer.mode == "window" else 1
    for train in sorted({t["train"] for t in trials}):
        mine = [t for t in trials if t["train"] == train and t["val"] >= fewest and t["threshold"] > 0 and train + t["val"] < have]
        if not mine or train < 1:
            continue
        count, mean, squares = moments[train]
        if not count:
            continue
        scale = np.sqrt(squares / count) or 1.0
        with np.errstate(invalid="ignore"):
            profile = (sums[train - 1] / counts[train - 1] - mean) / scale
        errors = np.abs((dev[train:] - mean) / scale - profile)
        record = {"train": train, "mean": mean, "scale": scale, "profile": profile, "pivot": [], "rows": [], "mus": [], "variances": []}
        record["trials"], record["vals"], record["limits"] = [t["trial_id"] for t in mine], [t["val"] for t in mine], []
        if scorer.mode == "window":
            pivot = errors.mean(axis=0)
            rows = errors - pivot
            gram, lengths = rows @ rows.T, (rows * rows).sum(axis=1)
            record["pivot"], record["rows"] = pivot, list(rows[: max(record["vals"])])
            for t in mine:
                held = slice(t["val"], t["val"] + t["threshold"])
                scores = prefix_scores(gram, gram[held], lengths[held], t["val"], scorer.ridge)
                record["limits"].append(np.quantile(scores, t["percentile"] / 100.0))
        else:
            points = running_moments(errors)
            for t in mine:
                n, mu, total = points[t["val"]]
                variance = total / n + scorer.ridge if n else np.nan
                scores = (errors[t["val"] : t["val"] + t["threshold"]] - mu) ** 2 / variance
                scores = scores[~np.isnan(scores)]
                record["limits"].append(np.quantile(scores, t["percentile"] / 100.0) if len(scores) else np.nan)
                record["mus"].append(mu)
                record["variances"].append(variance)
        out.append(record)
    return out


def trial_list(trials: DataFrame) -> list[dict]:
    """The trial table on the driver: it is made there and has some hundred rows."""
    return [r.asDict() for r in trials.select("trial_id", "train", "val", "threshold", "percentile").orderBy("trial_id").collect()]


def prefix_fits(ranked: DataFrame, trials: list[dict], scorer: ScorerSpec) -> DataFrame:
    """The prefix-moment table: one row per series and distinct ``train``, with the limits of its trials.

    A series has as many ranked windows as the largest trial asks for at most, so
    its list is bounded. Trials without a window in one of their splits have no
    entry; a limit is NaN where missing values leave no score for it.
    """
    listed = ranked.filter(F.col("rank") > 0).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("rank", "values"))).alias("_d"))
    dev = listed.select("series_id", F.col("_d.values").alias("dev"))

    def fit(batches):
        for pdf in batches:
            for series, rows in zip(pdf["series_id"], pdf["dev"]):
                found = _fits_of(np.stack([np.asarray(r, dtype=float) for r in rows]), trials, scorer)
                if found:
                    yield pd.DataFrame(found).assign(series_id=series)

    kind = ranked.schema["series_id"].dataType.simpleString()
    return dev.mapInPandas(fit, f"series_id {kind}, {_FITS}")


def trial_limits(fits: DataFrame) -> DataFrame:
    """``series_id, trial_id, limit``."""
    zipped = fits.select("series_id", F.explode(F.arrays_zip("trials", "limits")).alias("t"))
    return zipped.select("series_id", F.col("t.trials").alias("trial_id"), F.col("t.limits").alias("limit")).filter(~F.isnan("limit"))


def score_trials(ranked: DataFrame, fits: DataFrame | Sized, trials: list[dict], scorer: ScorerSpec) -> DataFrame:
    """Every window once, with arrays over ``trials`` in their order.

    ``scores`` has the window score, or in point mode the number of points above
    the limit; ``flags`` is 1, 0, or -1 where the window is a development window
    of that trial, the series has no model for it, or a missing value leaves no
    window score. Windows meet the fits of
    their series in blocks, so a hot series is many rows and the fits are not
    copied for each window.
    """
    place = {t["trial_id"]: i for i, t in enumerate(trials)}
    used = np.array([t["train"] + t["val"] + t["threshold"] for t in trials])
    names = ["window_id", "rank", "is_anomaly", "is_edge_case", "values"]
    packed = (
        ranked.withColumn("_block", F.floor(F.col("window_id") / BLOCK))
        .groupBy("series_id", "_block")
        .agg(F.collect_list(F.struct(*names)).alias("_w"))
        .select("series_id", *[F.col(f"_w.{n}").alias(n) for n in names])
    )
    fixed = fits if isinstance(fits, Sized) else settle(fits)
    fields = [c for c in fixed.df.columns if c != "series_id"]
    by_series = settle(fixed.df.groupBy("series_id").agg(F.collect_list(F.struct(*fields)).alias("fits")))
    # The nested records are wider than a column width can tell.
    met = attach(packed, Sized(by_series.df, by_series.rows, fixed.bytes), ["series_id"])

    def one(x, rank, fits):
        scores = np.full((len(x), len(trials)), np.nan)
        flags = np.full((len(x), len(trials)), -1, dtype=np.int8)
        for fit in fits:
            err = np.abs((x - fit["mean"]) / fit["scale"] - np.asarray(fit["profile"]))
            if scorer.mode == "window":
                rows = np.stack(fit["rows"])
                d = err - np.asarray(fit["pivot"])
                gram, along, lengths = rows @ rows.T, d @ rows.T, (d * d).sum(axis=1)
            for i, trial in enumerate(fit["trials"]):
                at, limit = place[trial], fit["limits"][i]
                if np.isnan(limit):
                    continue
                if scorer.mode == "window":
                    scores[:, at] = prefix_scores(gram, along, lengths, fit["vals"][i], scorer.ridge)
                    flags[:, at] = np.where(np.isnan(scores[:, at]), -1, scores[:, at] > limit)
                else:
                    scores[:, at] = ((err - fit["mus"][i]) ** 2 / fit["variances"][i] > limit).sum(axis=1)
                    flags[:, at] = scores[:, at] >= scorer.hard_k
        flags[(rank[:, None] > 0) & (rank[:, None] <= used[None, :])] = -1
        return list(scores), list(flags)

    def score(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                scores, flags = one(np.stack([np.asarray(v, dtype=float) for v in row.values]), np.asarray(row.rank), row.fits)
                yield pd.DataFrame(
                    {
                        "series_id": row.series_id, "window_id": row.window_id, "is_anomaly": row.is_anomaly, "is_edge_case": row.is_edge_case,
                        "scores": scores, "flags": flags,
                    }
                )

    kinds = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in ("series_id", "window_id", "is_anomaly", "is_edge_case"))
    return met.mapInPandas(score, f"{kinds}, scores array<double>, flags array<tinyint>")


def trial_flags(scored: DataFrame, trials: list[dict]) -> DataFrame:
    """``trial_id, is_anomaly, is_edge_case, is_flagged`` of the test windows of every trial: narrow rows, for counting."""
    numbers = F.array(*[F.lit(t["trial_id"]) for t in trials])
    each = scored.select("is_anomaly", "is_edge_case", F.posexplode("flags").alias("_at", "_f")).filter(F.col("_f") >= 0)
    return each.select(F.get(numbers, F.col("_at")).alias("trial_id"), "is_anomaly", "is_edge_case", (F.col("_f") == 1).alias("is_flagged"))
