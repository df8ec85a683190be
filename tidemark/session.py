"""Session helpers: time zone, written intermediate tables, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A table may be broadcast when its measured size stays below this bound.
BROADCAST_BYTES = 64 * 1024 * 1024


def pin_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="tidemark-")
    sc.setCheckpointDir(named)
    return named


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Sized:
    """A table with its measured row count and size (``seen``: further figures)."""

    df: DataFrame
    rows: int
    bytes: int
    seen: dict = field(default_factory=dict)


def _width(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(col)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        size = 8 * F.aggregate(col, F.lit(0), lambda n, inner: n + F.size(inner))
    elif isinstance(kind, T.ArrayType):
        size = 8 * F.size(col) * (len(kind.elementType) if isinstance(kind.elementType, T.StructType) else 1)
    elif isinstance(kind, T.MapType):
        size = 64 * F.size(col)
    elif isinstance(kind, T.StructType):
        size = F.lit(16 * max(1, len(kind)))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(0))


def settle(df: DataFrame, **metrics: Column) -> Sized:
    """Write ``df`` once to the shared folder and read it back.

    The expensive side (a scan of the raw table) then runs exactly once, later
    stages survive the loss of executors, and Catalyst plans with real sizes.
    Row count, size and the extra ``metrics`` are observed by the same job.
    """
    spark = df.sparkSession
    width = F.lit(0)
    for field in df.schema.fields:
        width = width + _width(field)
    watch = Observation()
    path = fresh_folder(spark, "settled")
    asked = [col.alias(name) for name, col in metrics.items()]
    watched = df.observe(watch, F.count(F.lit(1)).alias("_rows"), F.sum(width).alias("_bytes"), *asked)
    watched.write.parquet(path)
    seen = watch.get
    back = spark.read.schema(df.schema).parquet(path)
    return Sized(back, seen["_rows"], seen["_bytes"] or 0, {k: seen[k] for k in metrics})


def attach_scalar(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (an ungrouped aggregate) to every row.

    A scalar subquery: no join, and Spark raises if it returns a second row.
    """
    names = one_row.columns
    packed = rows.withColumn("_one", one_row.select(F.struct(*names)).scalar())
    return packed.select(*rows.columns, *[F.col("_one")[n].alias(n) for n in names])


def attach(
    rows: DataFrame,
    params: DataFrame | Sized,
    on: list[str],
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join one-row-per-key parameters to rows.

    The size of ``params`` is known (a plain table is written first to measure
    it): below ``limit`` it is broadcast and the rows do not move. Above, it is a plain
    shuffle join of a written table, in which adaptive execution splits the
    partitions of hot keys; no parameter row is copied for keys that are not hot.
    """
    if not on:
        return attach_scalar(rows, params.df if isinstance(params, Sized) else params)
    fixed = params if isinstance(params, Sized) else settle(params)
    if fixed.bytes <= limit:
        return rows.join(F.broadcast(fixed.df), on, how)
    return rows.join(fixed.df, on, how)
