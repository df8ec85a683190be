"""Counters of streaming queries that outlive a restart.

``query.recentProgress`` and in-memory totals end with the driver. Here every
progress event is one small file under (query id, batch id): the query id stays
the same as long as the checkpoint does, and a batch that is reported again
replaces its own file, so sums count every batch once.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

COUNTERS = ("rows", "windows", "ended", "buffered")
SCHEMA = "run_id string, input_rows long, " + ", ".join(f"{c} long" for c in COUNTERS)


class ProgressLog(StreamingQueryListener):
    """Writes the events of the queries of one session to ``folder``; add it to ``spark.streams``.

    ``counters`` of ``jobs.observed`` are kept where a query has them. Events are
    delivered behind the batch: if the driver dies between the two, that event is
    lost, and ``totals`` reports the batch as missing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()
        self.error: Exception | None = None

    def _end(self, run_id: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        seen = {k: v for row in (progress.observedMetrics or {}).values() for k, v in row.asDict().items()}
        row = (str(progress.runId), int(progress.numInputRows or 0), *[seen.get(c) for c in COUNTERS])
        path = f"{self.folder}/query_id={progress.id}/batch_id={progress.batchId}"
        try:
            self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
        except Exception as error:  # Spark drops what a listener raises: it is raised again by wait
            self.error = error

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._end(str(event.runId)).set()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until all events of a query that has ended are written."""
        if not self._end(str(query.runId)).wait(seconds):
            raise TimeoutError(f"no end of run {query.runId} was reported in {seconds} s")
        if self.error is not None:
            raise self.error


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """Per query id: sums over all its runs, the last number of waiting rows, and batches without an event."""
    log = spark.read.schema(f"{SCHEMA}, query_id string, batch_id long").parquet(folder)
    return log.groupBy("query_id").agg(
        F.sum("input_rows").alias("input_rows"),
        *[F.sum(c).alias(c) for c in ("rows", "windows", "ended")],
        F.max_by("buffered", F.when(F.col("buffered").isNotNull(), F.col("batch_id"))).alias("buffered"),
        F.count(F.lit(1)).alias("triggers"),
        F.count_distinct("run_id").alias("runs"),
        (F.max("batch_id") + 1 - F.count(F.lit(1))).alias("missing"),
    )
