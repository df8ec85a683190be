"""Synthetic anomalies injected into normal windows.

Every random choice is a hash of (seed, series, window, copy, purpose), so a
retried task or another partitioning gives the same windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import InjectSpec
from tidemark.functions.predicates import draw, rolled, uniform

KINDS = ("point", "level_shift", "noise", "temporal")


def copies(normal: DataFrame, n: int) -> DataFrame:
    """``n`` copies of every window, numbered by ``copy``."""
    return normal.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def inject(normal: DataFrame, spec: InjectSpec, length: int, per_hour: int = 2, values: str = "values") -> DataFrame:
    """Corrupted copies of normal windows: ``kind`` tells how, ``is_anomaly`` is true.

    Row-local on the dense vector: no shuffle.
    """
    unknown = set(spec.kinds) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown anomaly kind: {sorted(unknown)}")
    out = copies(normal, spec.copies)
    key = [F.lit(spec.seed).cast("string"), F.col("series_id"), F.col("window_id").cast("string"), F.col("copy").cast("string")]
    kinds = F.array(*[F.lit(k) for k in spec.kinds])
    out = out.withColumn("kind", F.get(kinds, F.pmod(draw(*key, "kind"), F.lit(len(spec.kinds))).cast("int")))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / length
    out = out.withColumn("_mean", mean)
    out = out.withColumn("_std", F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(x - F.col("_mean"), 2)) / length))

    def sign(*purpose) -> Column:
        return F.when(F.pmod(draw(*key, *purpose), F.lit(2)) == 0, -1.0).otherwise(1.0)

    # Distinct positions: the ones with the smallest draws.
    n_points = min(spec.point_count, length)
    ranked = F.array_sort(
        F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda p: F.struct(draw(*key, "place", p.cast("string")).alias("d"), p.alias("p")))
    )
    chosen = F.transform(F.slice(ranked, 1, n_points), lambda x: x["p"])
    out = out.withColumn("_chosen", F.when(F.col("kind") == "point", chosen))
    level_len, noise_len = int(length * spec.level_fraction), int(length * spec.noise_fraction)
    span = F.when(F.col("kind") == "level_shift", level_len).otherwise(noise_len)
    out = out.withColumn("_span", span).withColumn("_from", F.pmod(draw(*key, "start"), F.lit(length + 1) - F.col("_span")).cast("int"))
    out = out.withColumn("_sign", sign("sign"))

    def inside(i):
        return (i >= F.col("_from")) & (i < F.col("_from") + F.col("_span"))

    def gaussian(i):
        u = 1.0 - uniform(*key, "u", i.cast("string"))
        v = uniform(*key, "v", i.cast("string"))
        return F.sqrt(-2.0 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)

    corrupted = (
        F.when(
            F.col("kind") == "point",
            F.transform(
                values,
                lambda x, i: F.when(
                    F.array_contains(F.col("_chosen"), i), x + sign("sign", i.cast("string")) * spec.point_magnitude * F.col("_std")
                ).otherwise(x),
            ),
        )
        .when(
            F.col("kind") == "level_shift",
            F.transform(values, lambda x, i: F.when(inside(i), x + F.col("_sign") * spec.level_magnitude * F.col("_std")).otherwise(x)),
        )
        .when(
            F.col("kind") == "noise",
            F.transform(values, lambda x, i: F.when(inside(i), x + gaussian(i) * spec.noise_scale * F.col("_std")).otherwise(x)),
        )
        .otherwise(rolled(F.col(values), spec.shift_hours * per_hour, length))
    )
    return (
        out.withColumn(values, corrupted)
        .withColumn("is_anomaly", F.lit(True))
        .drop("_mean", "_std", "_chosen", "_span", "_from", "_sign")
    )
