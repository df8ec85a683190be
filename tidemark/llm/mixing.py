"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies (target size over source
size). The expected copies are prefix-summed inside the source in the order (size, id), one
random offset is added per source, and a document is emitted once for every integer boundary
that its stretch of the sum crosses. Ordering by size keeps the words taken from a source
within about one document of its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.session import settle

# Copies are counted in units of 2 ** -UNIT_BITS, so prefix sums are exact whatever the partitioning.
UNIT_BITS = 40
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Targets per source from (source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share the total size;
    a target stops at ``cap`` times its source, the excess is shared again by weight. Solved
    in closed form: with sources ordered by cap per weight, those before the first whose share
    fits are capped. One row per source meets in one task here, never a document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    choices = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = sizes.select(
        "source",
        "source_size",
        F.element_at(choices, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("_w"),
        (F.col("source_size") * cap).alias("_cap"),
    )
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").isNull(), "source")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = ranked.select(
        "*",
        F.row_number().over(order).alias("_rank"),
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
            / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        ).alias("_level"),
    )
    fits = F.col("_level") * F.col("_w") <= F.col("_cap")
    first = F.min_by("_level", F.when(fits, F.col("_rank"))).over(everything)
    share = F.least(F.col("_w") * first, F.col("_cap").cast("double"))
    return level.select("source", "source_size", F.coalesce(share, F.lit(0.0)).alias("target"))


def with_copies(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
    text: str = "text",
    columns: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken`` (words, repeats counted).

    Needs ``doc_id``, ``source`` and ``text``; ``columns`` names what is carried along besides id and
    source (default: all). Null text has size 0; a null source is a source of its own, named last; rows
    with equal ids are separate documents; a source without words has target 0 and no copies;
    an empty table gives an empty result. Columns of the names above are replaced.
    A third of all rows in one source is spread over range partitions.
    """
    carried = docs.columns if columns is None else ["doc_id", "source", *columns]
    rows = docs.select(
        *common.without(docs.select(*carried), ["size", "source_size", "target", "copies", "taken"]).columns,
        common.word_count(F.col(text)).alias("size"),
        common.null_safe(F.col("source")).alias("_source"),
    )
    written, runs = common.placed_in_order(rows, ["size", "doc_id"], "_source")
    sizes = written.groupBy("source").agg(F.sum("size").alias("source_size"))
    unit = 1 << UNIT_BITS
    rates = settle(
        source_targets(sizes, weights, cap).select(
            common.null_safe(F.col("source")).alias("_source"),
            "source_size",
            "target",
            F.floor(F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)) * unit)
            .cast("long")
            .alias("_each"),
            F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), common.null_safe(F.col("source")))), 1, 10), 16, 10)
            .cast("long")
            .alias("_offset"),
        )
    )
    joined = common.join_checked(common.join_checked(written, runs, ["_source", "_part"]), rates, ["_source"])
    rank = F.col("_at") - F.col("_first") + F.col("_before")
    earlier = (rank.cast("decimal(19,0)") * F.col("_each").cast("decimal(19,0)") + F.col("_offset")) % F.lit(unit)
    copies = F.shiftright(earlier.cast("long") + F.col("_each"), UNIT_BITS)
    return (
        joined.withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_source", "_part", "_at", "_first", "_n", "_before", "_each", "_offset")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with the columns of ``docs``."""
    counted = with_copies(docs.withColumn("_row", F.struct("*")), columns=["_row"], **options)
    repeated = counted.filter("copies > 0").withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return repeated.select("_row.*")
