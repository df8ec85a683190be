"""Confusion counts, derived metrics and score reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.predicates import ratio
from tidemark.session import attach


def confusion(rows: DataFrame, by: list[str], predicted: Column | str = "is_flagged", actual: Column | str = "is_anomaly") -> DataFrame:
    """tp, fp, fn, tn over the given rows (leave edge cases out beforehand)."""
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    a = F.col(actual) if isinstance(actual, str) else actual
    return rows.groupBy(*by).agg(
        F.count_if(p & a).alias("tp"),
        F.count_if(p & ~a).alias("fp"),
        F.count_if(~p & a).alias("fn"),
        F.count_if(~p & ~a).alias("tn"),
    )


def f_score(precision: Column, recall: Column, beta: float) -> Column:
    b2 = beta * beta
    return ratio((1 + b2) * precision * recall, b2 * precision + recall)


def metrics(counts: DataFrame, beta: float = 0.1) -> DataFrame:
    """Accuracy, precision, recall, F1 and F-beta; each 0 where its denominator is 0."""
    out = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    )
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return (
        out.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), total))
        .withColumn("f1_score", f_score(F.col("precision"), F.col("recall"), 1.0))
        .withColumn("f_beta_score", f_score(F.col("precision"), F.col("recall"), beta))
    )


def separability(scores: DataFrame, by: list[str]) -> DataFrame:
    """Largest normal and smallest anomalous score, their gap, and whether it is open."""
    out = scores.groupBy(*by).agg(
        F.max(F.when(~F.col("is_anomaly"), F.col("score"))).alias("max_normal"),
        F.min(F.when(F.col("is_anomaly"), F.col("score"))).alias("min_anomaly"),
    )
    return out.withColumn("gap", F.col("min_anomaly") - F.col("max_normal")).withColumn("separable", F.col("gap") > 0)


def score_histogram(scores: DataFrame, by: list[str], value: str, bins: int = 29) -> DataFrame:
    """Equal-width counts between the global minimum and maximum; the last bin is closed."""
    span = scores.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    placed = attach(scores, span, [])
    same = F.col("_hi") == F.col("_lo")
    bin_no = F.when(same, 1).otherwise(
        F.least(F.floor((F.col(value) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)) + 1, F.lit(bins))
    )
    return placed.groupBy(*by, bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def max_normalised(scores: DataFrame, by: list[str], value: str) -> DataFrame:
    """Scores over the largest score of their group."""
    top = scores.groupBy(*by).agg(F.max(value).alias("_top"))
    return attach(scores, top, by).withColumn("normalised", F.col(value) / F.col("_top")).drop("_top")


def leaderboard(trials: DataFrame, metric: str, n: int = 20) -> DataFrame:
    """Best ``n`` trials, ties to the earlier one (a top-k: per-task heaps, no full sort)."""
    return trials.orderBy(F.desc(metric), F.asc("trial_id")).limit(n)


def best_trial(trials: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """First-wins argmax."""
    return trials.groupBy(*by).agg(F.max_by(F.struct(*[c for c in trials.columns if c not in by]), F.struct(metric, -F.col("trial_id"))).alias("_b")).select(*by, "_b.*")


def newest(rows: DataFrame, n: int, order: str, key: str = "series_id") -> DataFrame:
    """Most recent ``n`` rows per series; the rank filter limits groups before the shuffle."""
    recent = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("recency", F.row_number().over(recent)).filter(F.col("recency") <= n)


def exemplars(windows: DataFrame) -> DataFrame:
    """First normal and first anomalous window of every series."""
    return windows.groupBy("series_id").agg(
        F.min(F.when(~F.col("is_anomaly"), F.col("window_id"))).alias("first_normal"),
        F.min(F.when(F.col("is_anomaly"), F.col("window_id"))).alias("first_anomaly"),
    )


def in_view(found: DataFrame, shown: DataFrame) -> DataFrame:
    """Flagged spans that meet the shown time range (``shown``: one row ``lo, hi``)."""
    return (
        attach(found, shown, [])
        .filter((F.col("anomaly_end") >= F.col("lo")) & (F.col("anomaly_start") <= F.col("hi")))
        .drop("lo", "hi")
    )
