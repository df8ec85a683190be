"""Streaming jobs: score windows as they complete, write results once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from tidemark.config import GridSpec, LocaliseSpec, ScorerSpec
from tidemark.operators import localise as loc
from tidemark.plans import flows
from tidemark.session import Sized, settle
from tidemark.sources.messages import format_results
from tidemark.streaming.windows import window_rows


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def write_batch(df: DataFrame, path: str, batch_id: int, format: str = "parquet") -> None:
    """One folder per batch, overwritten when the batch is replayed: exactly-once results."""
    df.write.mode("overwrite").format(format).save(batch_folder(path, batch_id))


def start(writer: DataStreamWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Every query has a checkpoint. ``every`` is a processing-time trigger, else all available input."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_down(query: StreamingQuery) -> None:
    """Let a query with a processing-time trigger take all input there is, then end it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream to Parquet until its input is used up."""
    start(stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint).awaitTermination()


def run_to_json(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream to a folder of JSON lines. The sink's log names the files of finished batches, once each."""
    return start(stream.writeStream.format("json").outputMode("append").option("path", path), checkpoint, every)


def follow_json(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """What ``run_to_json`` has committed, as a stream: files of a batch that failed are not in the log and not read.

    A folder that no query has written to is an error: the log is what makes the rows appear once.
    """
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_spark_metadata")
    if not log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
        raise ValueError(f"{path} has no log of a streaming sink")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def reply_rows(windows: DataFrame, params: Sized, grid: GridSpec, scorer: ScorerSpec, by: list[str], where: LocaliseSpec = LocaliseSpec()) -> DataFrame:
    """Windows of a stream to replies as text fields, row by row behind the stateful operator: fit for any streaming sink."""
    rows = window_rows(windows) if "kind" in windows.columns else windows
    return format_results(flows.detect(rows, params, grid, scorer, by, where), ["series_id", "window_id"])


def detection_sink(
    params: DataFrame | Sized, grid: GridSpec, scorer: ScorerSpec, by: list[str], out: str, where: LocaliseSpec = LocaliseSpec(), formatted: bool = True
):
    """A ``foreachBatch`` function over windows: replies, flagged log and formatted JSON rows.

    Each micro-batch is scored and localised row by row and written once as
    ``out/scored``; replies, flagged log and JSON rows are projections of that file. Writes
    ``out/replies``, ``out/flagged`` (nested localisation and top points) and
    ``out/formatted`` (five text fields as JSON). One folder per batch, overwritten on replay.
    """
    fixed = params if isinstance(params, Sized) else settle(params)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        windows = window_rows(batch) if "kind" in batch.columns else batch
        scored = loc.located(flows.score_windows(windows, fixed, scorer, by), grid, where)
        rank_by = "point_scores" if "point_scores" in scored.columns else "err"
        points = F.transform(
            loc.top_places(rank_by, where.top),
            lambda p: F.struct(
                F.timestamp_seconds(F.unix_seconds("start_ts") + p * grid.step_seconds).alias("ts"),
                F.get("values", p).alias("value"),
                F.get(F.col(rank_by), p).alias("point_score"),
            ),
        )
        kept = ["series_id", "window_id", "start_ts", "end_ts", "is_scored", "is_flagged", "window_score", flows.reply_limit(scored), "_place"]
        slim = scored.select(*kept, F.when(F.col("is_flagged"), F.array_sort(points)).alias("points"))
        write_batch(slim, f"{out}/scored", batch_id)
        done = spark.read.schema(slim.schema).parquet(batch_folder(f"{out}/scored", batch_id))
        replies = flows.replies(done, grid, where)
        write_batch(replies, f"{out}/replies", batch_id)
        log = flows.replies(done.filter("is_flagged"), grid, where, keep=["points"])
        write_batch(log, f"{out}/flagged", batch_id)
        if formatted:
            write_batch(format_results(replies, ["series_id", "window_id"]), f"{out}/formatted", batch_id, "json")

    return handle


def detect_stream(windows: DataFrame, params, grid, scorer, by, out: str, checkpoint: str, every: str | None = None, **rest) -> StreamingQuery:
    """Windows stream to scored, localised results."""
    sink = detection_sink(params, grid, scorer, by, out, **rest)
    return start(windows.writeStream.foreachBatch(sink).outputMode("append"), checkpoint, every)


def observed(stream: DataFrame, name: str = "progress") -> DataFrame:
    """Row and window counters in the query's progress, without an action of their own."""
    return stream.observe(
        name,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("kind") == "window").alias("windows"),
        F.count_if(F.col("kind") == "ended").alias("ended"),
        F.max("buffered").alias("buffered"),
    )


class Totals(StreamingQueryListener):
    """Rows and triggers of every query since it was added to ``spark.streams``; nothing is forgotten.

    ``query.recentProgress`` keeps the last 100 triggers only.
    """

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.triggers: dict[str, int] = {}
        self.last: dict[str, dict] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        key = str(progress.id)
        self.rows[key] = self.rows.get(key, 0) + int(progress.numInputRows or 0)
        self.triggers[key] = self.triggers.get(key, 0) + 1
        seen = {k: v for row in (progress.observedMetrics or {}).values() for k, v in row.asDict().items()}
        self.last[key] = {"batch_id": progress.batchId, "last_batch": progress.numInputRows, "total": self.rows[key], **seen}

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
