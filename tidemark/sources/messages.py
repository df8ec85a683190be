"""JSON messages: encode, decode, replay, result formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("value", T.IntegerType()),
        T.StructField("produced_at", T.StringType()),
        T.StructField("sequence_id", T.IntegerType()),
    ]
)
REQUEST = T.StructType(
    [
        T.StructField("values", T.ArrayType(T.DoubleType())),
        T.StructField("window_start", T.StringType()),
        T.StructField("window_end", T.StringType()),
    ]
)
ISO = "yyyy-MM-dd'T'HH:mm:ss"


def message_json(produced_at: Column | None = None) -> Column:
    """One message of columns ``ts, value, sequence_id``; the value is cut to an integer."""
    made = F.date_format(F.current_timestamp(), ISO) if produced_at is None else produced_at
    return F.to_json(
        F.struct(
            F.date_format("ts", ISO).alias("timestamp"),
            F.col("value").cast("long").alias("value"),
            made.alias("produced_at"),
            F.col("sequence_id"),
        )
    )


def encode(rows: DataFrame, produced_at: Column | None = None) -> DataFrame:
    """``key, value`` as a message sink takes them; the key is the sequence id as text."""
    return rows.select(F.col("sequence_id").cast("string").alias("key"), message_json(produced_at).alias("value"))


def write_messages(rows: DataFrame, format: str = "kafka", **options) -> None:
    encode(rows).write.format(format).options(**options).save()


def decode(raw: DataFrame, keep: tuple = ()) -> DataFrame:
    """Binary ``value`` to typed columns. A row in which nothing could be read is a reject."""
    parsed = raw.select(*keep, F.from_json(F.col("value").cast("string"), MESSAGE).alias("data"))
    flat = parsed.select(*keep, "data.*").withColumn("ts", F.col("timestamp").try_cast("timestamp"))
    nothing = F.col("timestamp").isNull() & F.col("value").isNull() & F.col("sequence_id").isNull() & F.col("produced_at").isNull()
    return flat.withColumn("is_reject", nothing)


def read_messages(spark, format: str = "kafka", **options) -> DataFrame:
    """Streaming message source. Kafka options default to the earliest offsets and 50 per trigger."""
    if format == "kafka":
        options = {"startingOffsets": "earliest", **options}
        if not {"maxOffsetsPerTrigger", "maxBytesPerTrigger"} & options.keys():
            raise ValueError("say how much a trigger takes: maxOffsetsPerTrigger")
    return spark.readStream.format(format).options(**options).load()


def skip_start(indexed: DataFrame, n: int) -> DataFrame:
    """Drop the first ``n`` rows of every series; a series not longer than that yields nothing."""
    return indexed.filter(F.col("idx") >= n).withColumn("idx", F.col("idx") - n).withColumn("total", F.col("total") - n)


def replay(indexed: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times: timestamps repeat, sequence ids keep rising."""
    again = indexed.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return again.withColumn("sequence_id", F.col("iteration") * F.col("total") + F.col("idx"))


def encode_request(values: Column, start: Column, end: Column) -> Column:
    return F.to_json(F.struct(values.alias("values"), start.alias("window_start"), end.alias("window_end")))


def decode_request(body: Column) -> Column:
    return F.from_json(body, REQUEST)


def format_results(replies: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Five text fields under their published names, behind ``keys`` where there are many series."""
    names = ["is_anomaly", "anomaly_score", "threshold", "window_start", "window_end"]
    return replies.select(*(keys or []), *[F.col(n).cast("string").alias(n) for n in names])
