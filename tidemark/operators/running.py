"""Running sums over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import attach, settle


def running_sums(rows: DataFrame, by: list[str], order: list[str], sums: list[str], bounded: bool = False) -> DataFrame:
    """``rows`` with ``upto_<name>`` for every name of ``sums``: its sum over the group's rows up to this one in ``order``.

    ``bounded`` groups are summed by one window. Others are range-partitioned on (group, order) and written once, so that a hot
    group spreads over many tasks; a window runs inside a partition, and the sums of the partitions before it are added.
    ``order`` must tell the rows of a group apart.
    """
    upto = {name: f"upto_{name}" for name in sums}
    if bounded:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *[F.sum(name).over(window).alias(as_) for name, as_ in upto.items()])
    keys = [*by, "_run"]
    placed = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_run", F.spark_partition_id())
    placed = settle(placed).df
    each = placed.groupBy(*keys).agg(*[F.sum(name).alias(f"_{name}") for name in sums])
    earlier = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(*keys, *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(name).over(inside).alias(f"_in_{name}") for name in sums])
    total = [(F.col(f"_in_{name}") + F.col(f"_before_{name}")).alias(as_) for name, as_ in upto.items()]
    return attach(summed, before, keys).select(*rows.columns, *total)
