"""Series from Parquet tables and CSV files, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.predicates import parse_time
from tidemark.session import pin_utc

SERIES_CSV = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("value", T.DoubleType())])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table with zone-less timestamps read as UTC instants.

    The cast sits in the projection, so column pruning still reaches the scan.
    """
    pin_utc(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(
        *[
            F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_series_csv(spark: SparkSession, path: str, series_id: str = "series") -> DataFrame:
    """Header CSV ``timestamp,value``. A missing path is an error at analysis time."""
    rows = pin_utc(spark).read.schema(SERIES_CSV).option("header", True).csv(path)
    return rows.select(F.lit(series_id).alias("series_id"), F.col("timestamp").alias("ts"), "value")


def stream_series_csv(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.csv",
    files_per_trigger: int | None = None,
    bytes_per_trigger: int | None = None,
    by_folder: bool = False,
) -> DataFrame:
    """Directory source: header CSV files whose name matches ``pattern``, tracked by the checkpoint.

    Fields stay text, as a delimited reader hands them over; ``parse_fields`` types them. With
    ``by_folder`` the files lie in folders ``series_id=..`` and carry that name.
    """
    text = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("value", T.StringType())])
    if by_folder:
        text = text.add("series_id", T.StringType())
    reader = pin_utc(spark).readStream.schema(text).option("header", True).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.csv(folder)


def parse_fields(rows: DataFrame) -> DataFrame:
    """Trim both text fields and type them; a bad field becomes null (``is_bad``)."""
    ts = parse_time(F.col("timestamp"))
    value = F.trim("value").try_cast("double")
    return rows.withColumn("ts", ts).withColumn("number", value).withColumn(
        "is_bad", F.col("ts").isNull() | F.col("number").isNull()
    )


def series_summary(rows: DataFrame) -> DataFrame:
    """Count, range and first / last value of every series in one aggregation."""
    return rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.min_by("value", "ts").alias("first_value"),
        F.max_by("value", "ts").alias("last_value"),
    )
