"""Exact interpolated percentiles of pools that do not fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import running_sums
from tidemark.session import attach, settle

SKETCH_ACCURACY = 100_000
# Distinct values inside all brackets that one task may rank; more are ranked over range partitions.
INSIDE = 1 << 20


def exact_percentiles(
    rows: DataFrame, by: list[str], value: str, fractions: list[float], accuracy: int = SKETCH_ACCURACY, most: int = INSIDE
) -> DataFrame:
    """``by, cut, fraction, threshold`` with linear interpolation, for any pool size.

    Two passes. A mergeable sketch brackets every wanted rank; then rows outside
    the brackets are only counted and the distinct values inside are ranked, over range
    partitions where they are many.
    Both passes reduce map-side, so neither a large pool nor one value that makes
    up a third of it is shuffled or lands in a single task. ``most`` distinct values are ranked in one task.
    """
    slack = 2.0 / accuracy
    wanted = sorted(set(fractions))
    k = len(wanted)
    grid = F.array(*[F.lit(float(p)) for p in wanted])
    lows = F.array(*[F.lit(max(0.0, p - slack)) for p in wanted])
    highs = F.array(*[F.lit(min(1.0, p + slack)) for p in wanted])
    sketch = rows.groupBy(*by).agg(
        F.percentile_approx(value, F.concat(lows, highs), F.lit(accuracy)).alias("_edges"), F.count(value).alias("_n")
    )
    sketch = sketch.select(
        *by, F.slice("_edges", 1, k).alias("_lows"), F.slice("_edges", k + 1, k).alias("_highs"), "_n"
    )
    met = attach(rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")), sketch, by)

    # Brackets rise with the fraction, so two small integers say where a value lies.
    placed = met.withColumn("_over", F.size(F.filter("_lows", lambda x: x <= F.col("_v")))).withColumn(
        "_past", F.size(F.filter("_highs", lambda x: x < F.col("_v")))
    )
    # One pass: rows outside all brackets collapse per task, values inside stay distinct.
    inner = F.when(F.col("_over") > F.col("_past"), F.col("_v"))
    small = settle(
        placed.groupBy(*by, "_over", "_past", inner.alias("_v")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.first("_n").alias("n")
        )
    )
    few, small = small.rows <= most, small.df
    cells = small.groupBy(*by, "_over", "_past").agg(
        F.sum("_c").alias("c"), F.min("least").alias("least"), F.max("most").alias("most"), F.first("n").alias("n")
    )
    cells = cells.groupBy(*by).agg(F.collect_list(F.struct("_over", "_past", "c", "least", "most")).alias("_cells"), F.first("n").alias("n"))
    cuts = cells.select(*by, "n", "_cells", F.posexplode(grid).alias("cut", "fraction"))
    under = F.filter("_cells", lambda x: x["_over"] <= F.col("cut"))
    above = F.filter("_cells", lambda x: x["_past"] > F.col("cut"))
    cuts = cuts.select(
        *by,
        "cut",
        "fraction",
        (F.col("fraction") * (F.col("n") - 1)).alias("rank"),
        F.aggregate(under, F.lit(0).cast("long"), lambda a, x: a + x["c"]).alias("below"),
        F.array_max(F.transform(under, lambda x: x["most"])).alias("before"),
        F.array_min(F.transform(above, lambda x: x["least"])).alias("after"),
    )

    inside = small.filter(F.col("_v").isNotNull()).select(
        *by, "_v", "_c", F.explode(F.sequence(F.col("_past"), F.col("_over") - 1)).alias("cut")
    )
    ranked = running_sums(inside, [*by, "cut"], ["_v"], ["_c"], bounded=few).withColumnRenamed("upto__c", "_upto")
    inside = ranked.join(cuts, [*by, "cut"])

    def at(rank):
        return F.min(F.when(F.col("below") + F.col("_upto") > rank, F.col("_v")))

    lower, upper = F.floor("rank"), F.ceil("rank")
    picked = inside.groupBy(*by, "cut").agg(
        F.first("fraction").alias("fraction"),
        F.first("rank").alias("rank"),
        F.first("below").alias("below"),
        (F.first("below") + F.sum("_c")).alias("reach"),
        F.first("before").alias("before"),
        F.first("after").alias("after"),
        at(lower).alias("_a"),
        at(upper).alias("_b"),
    )

    def resolve(rank, found):
        missed = F.raise_error(F.lit("percentile bracket missed its rank")).cast("double")
        return (
            F.when(rank == F.col("below") - 1, F.col("before"))
            .when((rank >= F.col("below")) & (rank < F.col("reach")), F.col(found))
            .when(rank == F.col("reach"), F.col("after"))
            .otherwise(missed)
        )

    a, b = resolve(lower, "_a"), resolve(upper, "_b")
    part = F.col("rank") - lower
    return picked.select(*by, "cut", "fraction", (a + (b - a) * part).alias("threshold"))


def _fewer(ranks: Column, n: int, than: Column) -> Column:
    """How many of the ``n`` sorted ``ranks`` are less than ``than``: a search by halves."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    more = lambda found, step: F.when(F.get(ranks, found + step - 1) < than, step).otherwise(0)
    return F.aggregate(steps, F.lit(0), lambda found, step: found + more(found, step))


def ranked_percentiles(counted: DataFrame, by: list[str], value: str, rows: str, fractions: list[float]) -> DataFrame:
    """``by, cut, fraction, threshold`` like ``exact_percentiles``, of distinct values with their row counts, for many fractions.

    One running sum over range partitions says which ranks a value takes; only values that take a wanted rank go on.
    """
    wanted = sorted(set(fractions))
    grid = F.array(*[F.lit(float(p)) for p in wanted])
    present = counted.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.col(rows).alias("_c"))
    totals = settle(present.groupBy(*by).agg(F.sum("_c").alias("_n"))).df
    exact = F.transform(grid, lambda p: p * (F.col("_n") - 1))
    ends = F.concat(F.transform(exact, lambda r: F.floor(r)), F.transform(exact, lambda r: F.ceil(r)))
    asked = attach(running_sums(present, by, ["_v"], ["_c"]), totals.select(*by, F.array_sort(ends).alias("_ranks")), by)
    first, last = (_fewer(F.col("_ranks"), 2 * len(wanted), than) for than in (F.col("upto__c") - F.col("_c"), F.col("upto__c")))
    taken = asked.withColumn("_first", first).withColumn("_last", last)
    taken = taken.filter("_last > _first")
    taken = settle(taken.select(*by, "_v", F.explode(F.array_distinct(F.slice("_ranks", F.col("_first") + 1, F.col("_last") - F.col("_first")))).alias("_rank"))).df
    cuts = totals.select(*by, "_n", F.posexplode(grid).alias("cut", "fraction")).withColumn("rank", F.col("fraction") * (F.col("_n") - 1))
    for name, rank in (("_a", F.floor("rank")), ("_b", F.ceil("rank"))):
        cuts = cuts.withColumn("_rank", rank).join(taken.withColumnRenamed("_v", name), [*by, "_rank"]).drop("_rank")
    part = F.col("rank") - F.floor("rank")
    return cuts.select(*by, "cut", "fraction", (F.col("_a") + (F.col("_b") - F.col("_a")) * part).alias("threshold"))
