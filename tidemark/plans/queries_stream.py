"""Registered queries: streaming runs over the given tables, compared with the batch answer."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tidemark.functions import predicates as fn
from tidemark.operators.grid import points
from tidemark.operators.segment import dense_index
from tidemark.plans import flows, shared as s
from tidemark.plans.catalog import query
from tidemark.session import fresh_folder, pin_utc, settle
from tidemark.sources import tables
from tidemark.streaming import jobs
from tidemark.streaming.ordered import keyed_state, ordered_windows_stream
from tidemark.streaming.progress import ProgressLog, totals
from tidemark.streaming.windows import count_windows_stream, sunday_gate, window_rows

# What one trigger reads at most.
TRIGGER_BYTES = 256 << 20


def event_stream(spark, folder):
    """The event table as a file stream; ``event_id`` is the sequence id."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # A pattern, so that the table may be one file or a folder of files.
    pin_utc(spark)
    raw = spark.readStream.schema(schema).option("maxBytesPerTrigger", TRIGGER_BYTES).parquet(f"{folder}/events.parque[t]")
    return raw.select(F.col("event_type").alias("series_id"), F.col("event_id").alias("sequence_id"), F.col("ts").cast("timestamp").alias("ts"), "value")


def grid_stream(spark, folder, buckets):
    """The gap-free grid, written by a batch job and read back as a file stream."""
    rows = points(s.regular_windows(buckets, s.DAY, keep_tail=True), s.DAY)
    path = fresh_folder(spark, "grid")
    rows.select("series_id", F.col("idx").alias("sequence_id"), "ts", "value").write.parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", TRIGGER_BYTES).parquet(path)


@query(
    "K2 K3 K6 D2",
    """
WITH raw AS (SELECT event_type AS series_id, event_id, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx,
  count(*) OVER (PARTITION BY event_type) AS total FROM events)
SELECT series_id, idx // 336 AS window_id, strftime(arg_min(ts, idx), '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(arg_max(ts, idx), '%Y-%m-%d %H:%M:%S') AS end_ts,
  round(sum(value), 3) AS total FROM raw WHERE idx // 336 < total // 336 GROUP BY 1, 2""",
)
def streamed_tumbling_windows(spark, folder):
    stream = window_rows(count_windows_stream(event_stream(spark, folder), 336))
    out = fresh_folder(spark, "tumbling")
    jobs.run_to_parquet(stream, out, fresh_folder(spark, "checkpoint"))
    done = spark.read.schema(stream.schema).parquet(out)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return done.select("series_id", "window_id", s.stamp("start_ts").alias("start_ts"), s.stamp("end_ts").alias("end_ts"), F.round(total, 3).alias("total"))


@query(
    "K4 P2 P3 W5",
    s.grid_sql(s.EVENT_BUCKETS, 1800, 1)
    + f"""
SELECT a.series_id, a.idx AS start_idx, {s.sql_stamp('any_value(a.sec)')} AS start_ts, {s.sql_stamp('max(b.sec)')} AS end_ts, sum(b.value)::BIGINT AS total
FROM points a JOIN points b ON a.series_id = b.series_id AND b.idx BETWEEN a.idx AND a.idx + 335
WHERE dayofweek(make_timestamp(a.sec * 1000000)) = 0 AND a.sec % 86400 < 60
  AND a.sec >= epoch_us(TIMESTAMP '2024-01-10 00:00:00') // 1000000
GROUP BY a.series_id, a.idx HAVING count(*) = 336""",
)
def streamed_sliding_windows(spark, folder):
    stream = window_rows(count_windows_stream(grid_stream(spark, folder, s.event_buckets(spark, folder)), 336, step=1, gate=sunday_gate("2024-01-10")))
    out = fresh_folder(spark, "sliding")
    jobs.run_to_parquet(stream, out, fresh_folder(spark, "checkpoint"))
    done = spark.read.schema(stream.schema).parquet(out)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x).cast("long")
    return done.select("series_id", F.col("window_id").alias("start_idx"), s.stamp("start_ts").alias("start_ts"), s.stamp("end_ts").alias("end_ts"), total.alias("total"))


@query(
    "K5 S8 D1 M8",
    s.POINT_SQL + f" SELECT series_id, window_id, {s.sql_stamp('ws')} AS window_start, is_flagged AS is_anomaly, round(window_score, 5) AS anomaly_score FROM wpoint",
)
def streamed_scores(spark, folder):
    """Stateful windows, scored with parameters fitted in batch, written per micro-batch."""
    windows = s.prepared(spark, folder)
    params = flows.fit_profile_model(windows, s.DAY, s.POINT, s.BY)
    stream = count_windows_stream(grid_stream(spark, folder, s.value_buckets(spark, folder)), 48)
    out = fresh_folder(spark, "scores")
    jobs.detect_stream(stream, params, s.DAY, s.POINT, s.BY, out, fresh_folder(spark, "checkpoint")).awaitTermination()
    done = spark.read.parquet(f"{out}/replies")
    return done.select("series_id", "window_id", s.stamp("window_start").alias("window_start"), "is_anomaly", F.round("anomaly_score", 5).alias("anomaly_score"))


@query(
    "K8 K2 A17",
    """SELECT event_type AS series_id, count(*) % 336 AS buffered, count(*) AS seen, count(*) // 336 AS emitted FROM events GROUP BY 1""",
)
def streamed_progress(spark, folder):
    """Counters per series after the last trigger: seen rows, finished windows, rows waiting."""
    stream = count_windows_stream(event_stream(spark, folder), 336, with_status=True).filter(F.col("kind") == "buffering")
    out = fresh_folder(spark, "progress")
    jobs.run_to_parquet(stream, out, fresh_folder(spark, "checkpoint"))
    done = spark.read.schema(stream.schema).parquet(out)
    last = done.groupBy("series_id").agg(F.max_by(F.struct("buffered", "seen", "emitted"), "seen").alias("l"))
    return last.select("series_id", "l.buffered", "l.seen", "l.emitted")


@query(
    "K3 K8",
    """SELECT event_type AS series_id, count(*) AS seen, count(*) FILTER (event_id < (SELECT count(*) // 2 FROM events)) AS late, count(*) // 336 AS emitted
FROM events GROUP BY 1""",
)
def late_row_counts(spark, folder):
    """The later half of the events arrives first: every row of the other half is late, counted and kept."""
    rows = s.events(spark, folder)
    half = rows.count() // 2
    source, out = fresh_folder(spark, "source"), fresh_folder(spark, "late")
    rows.filter(F.col("event_id") >= half).write.parquet(source)
    schema = spark.read.parquet(source).schema
    checkpoint = fresh_folder(spark, "checkpoint")

    def run():
        raw = spark.readStream.schema(schema).parquet(source)
        typed = raw.select(F.col("event_type").alias("series_id"), F.col("event_id").alias("sequence_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
        stream = count_windows_stream(typed, 336, with_status=True).filter(F.col("kind") == "buffering")
        jobs.run_to_parquet(stream, out, checkpoint)
        return stream.schema

    run()
    rows.filter(F.col("event_id") < half).write.mode("append").parquet(source)
    done = spark.read.schema(run()).parquet(out)
    last = done.groupBy("series_id").agg(F.max_by(F.struct("seen", "late", "emitted"), "seen").alias("l"))
    return last.select("series_id", "l.seen", "l.late", "l.emitted")


@query(
    "K8 K2",
    """WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT sum(n)::BIGINT AS input_rows, sum(n // 336)::BIGINT AS windows, 2::BIGINT AS runs, 0::BIGINT AS missing, true AS many_triggers FROM n""",
)
def durable_progress(spark, folder):
    """Counters of a query over many triggers and a restart, read back from their log."""
    rows = s.events(spark, folder)
    half = rows.count() // 2
    source, out, log_folder = fresh_folder(spark, "source"), fresh_folder(spark, "windows"), fresh_folder(spark, "log")
    checkpoint = fresh_folder(spark, "checkpoint")
    for part in (F.col("event_id") < half, F.col("event_id") >= half):
        rows.filter(part).repartition(4, "event_id").write.mode("append").parquet(source)
        raw = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        typed = raw.select(F.col("event_type").alias("series_id"), F.col("event_id").alias("sequence_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
        stream = jobs.observed(count_windows_stream(typed, 336, with_status=True))
        log = ProgressLog(spark, log_folder)
        spark.streams.addListener(log)
        try:
            query = jobs.start(stream.writeStream.format("parquet").option("path", out), checkpoint)
            query.awaitTermination()
            log.wait(query)
        finally:
            spark.streams.removeListener(log)
    return totals(spark, log_folder).select("input_rows", "windows", "runs", "missing", (F.col("triggers") >= 4).alias("many_triggers"))


MESSAGE_SQL = s.POINT_SQL + f""", jt AS (SELECT series_id, window_id, ws, we, is_flagged FROM wpoint)
SELECT j.series_id, j.window_id, {s.sql_stamp('j.ws')} AS window_start, {s.sql_stamp('j.we')} AS window_end, CASE WHEN j.is_flagged THEN 'true' ELSE 'false' END AS is_anomaly,
  CASE WHEN j.is_flagged THEN 3 ELSE 0 END AS n_points FROM jt j"""


def messages_to_json(spark, folder, files_per_trigger: int, every: str | None = None):
    """JSON messages to decoded rows, windows, scores, JSON rows and flagged log; both outputs are read.

    The messages lie in six files, each with rows of the whole time, so with few files a trigger most rows come
    long before their turn: the windows wait for it in state.
    """
    windows = s.prepared(spark, folder)
    params = flows.fit_profile_model(windows, s.DAY, s.POINT, s.BY)
    grid = points(s.regular_windows(s.value_buckets(spark, folder), s.DAY, keep_tail=True), s.DAY)
    body = F.to_json(F.struct("series_id", F.col("idx").alias("sequence_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "value"))
    source, out = fresh_folder(spark, "messages"), fresh_folder(spark, "scores")
    grid.select(body.alias("value")).repartition(6, "value").write.text(source)
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(source)
    fields = F.from_json("value", "series_id string, sequence_id long, timestamp string, value double")
    typed = raw.select(fields.alias("m")).select("m.series_id", "m.sequence_id", fn.parse_time(F.col("m.timestamp")).alias("ts"), "m.value")
    with keyed_state(spark):
        job = jobs.detect_stream(ordered_windows_stream(typed, 48), params, s.DAY, s.POINT, s.BY, out, fresh_folder(spark, "checkpoint"), every)
    jobs.run_down(job) if every else job.awaitTermination()
    shown = spark.read.schema(REPLY_TEXT).json(f"{out}/formatted")
    log = spark.read.parquet(f"{out}/flagged").select("series_id", "window_id", F.size("points").alias("n"))
    both = shown.join(log, ["series_id", "window_id"], "left")
    shown_time = lambda c: s.stamp(fn.parse_time(F.col(c))).alias(c)
    return both.select(
        "series_id", "window_id", shown_time("window_start"), shown_time("window_end"), "is_anomaly", F.coalesce("n", F.lit(0)).alias("n_points")
    )


REPLY_TEXT = "is_anomaly string, anomaly_score string, threshold string, window_start string, window_end string, series_id string, window_id long"


@query(
    "S7 K10 K11 K5 M8",
    s.POINT_SQL
    + f""" SELECT series_id, window_id, {s.sql_stamp('ws')} AS window_start, {s.sql_stamp('we')} AS window_end, is_flagged AS is_anomaly, round(window_score, 4) AS anomaly_score FROM wpoint""",
)
def chained_streams(spark, folder):
    """Rows to replies in one query with a JSON sink, replies to a typed table in a second that follows it; both are restarted half-way."""
    params = flows.fit_profile_model(s.prepared(spark, folder), s.DAY, s.POINT, s.BY)
    grid = points(s.regular_windows(s.value_buckets(spark, folder), s.DAY, keep_tail=True), s.DAY)
    rows = settle(grid.select("series_id", F.col("idx").alias("sequence_id"), "ts", "value")).df
    middle = (rows.agg(F.max("sequence_id")).first()[0] or 0) // 2
    source, between, out, first, second = (fresh_folder(spark, n) for n in ("rows", "replies", "typed", "checkpoint", "checkpoint"))
    for part in (F.col("sequence_id") < middle, F.col("sequence_id") >= middle):
        rows.filter(part).write.mode("append").parquet(source)
        raw = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", TRIGGER_BYTES).parquet(source)
        with keyed_state(spark):
            job = jobs.run_to_json(jobs.reply_rows(ordered_windows_stream(raw, 48), params, s.DAY, s.POINT, s.BY), between, first)
        job.awaitTermination()
        text = jobs.follow_json(spark, between, REPLY_TEXT)
        typed = text.select(
            "series_id", "window_id", fn.parse_time(F.col("window_start")).alias("window_start"), fn.parse_time(F.col("window_end")).alias("window_end"),
            (F.col("is_anomaly") == "true").alias("is_anomaly"), F.col("anomaly_score").cast("double").alias("anomaly_score"),
        )
        jobs.run_to_parquet(typed, out, second)
    done = spark.read.schema(typed.schema).parquet(out)
    shown = [s.stamp(c).alias(c) for c in ("window_start", "window_end")]
    return done.select("series_id", "window_id", *shown, "is_anomaly", F.round("anomaly_score", 4).alias("anomaly_score"))


@query("K1 K5 K9 K10 K11 S7 S8 D1 M8", MESSAGE_SQL)
def streamed_messages_to_json(spark, folder):
    """All files in one trigger."""
    return messages_to_json(spark, folder, 6)


@query("K1 K2 K11 D1", MESSAGE_SQL)
def streamed_messages_in_steps(spark, folder):
    """Two files every second: a processing-time trigger with admission; the rows are those of one trigger."""
    return messages_to_json(spark, folder, 2, "1 second")


@query(
    "K3 K6 K7",
    """WITH raw AS (SELECT event_type AS series_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT series_id, any_value(n // 2) AS seen_at_pause, any_value((n // 2) % 336) AS waiting_at_pause, any_value((n // 2) // 336) AS windows_at_pause,
  any_value(least(n // 2 // 336, 3)) AS kept_at_pause, any_value(n // 336) AS windows, round(sum(value) FILTER (idx < n // 336 * 336), 3) AS total
FROM raw GROUP BY series_id HAVING any_value(n) >= 672""",
)
def idle_and_resumed_series(spark, folder):
    """Half of every series, a pause until each is marked as ended, then the other half, backwards: windows go on where they stopped."""
    source, out, checkpoint = (fresh_folder(spark, n) for n in ("source", "resumed", "checkpoint"))
    rows = dense_index(s.events(spark, folder).select(F.col("event_type").alias("series_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value"), ["event_id"])
    rows = settle(rows.filter("total >= 672").select("series_id", F.col("idx").alias("sequence_id"), "ts", "value", (F.col("idx") < F.floor(F.col("total") / 2)).alias("early"))).df
    half, whole = rows.filter("early").count(), rows.count()
    if not whole:
        return spark.createDataFrame([], "series_id string, seen_at_pause long, waiting_at_pause int, windows_at_pause long, kept_at_pause int, windows long, total double")
    rows.filter("early").drop("early").write.parquet(source)
    raw = spark.readStream.schema(rows.drop("early").schema).parquet(source)
    stream = ordered_windows_stream(raw, 336, idle_seconds=3)
    with keyed_state(spark):
        job = jobs.start(stream.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint, "1 second")
    done = lambda: spark.read.schema(stream.schema).parquet(out)

    def wait_for_pause(seen: int) -> None:
        """Until the ``ended`` rows of all series add up; timers keep such a query busy, so it never reports that input is used up."""
        while job.isActive:
            time.sleep(1)
            ended = done().filter("kind = 'ended'").groupBy("series_id").agg(F.max("seen").alias("seen")) if job.lastProgress else None
            if ended is not None and ended.agg(F.sum("seen")).first()[0] == seen:
                return
        raise job.exception() or RuntimeError("the stream ended early")

    try:
        wait_for_pause(half)
        rows.filter("NOT early").drop("early").orderBy(F.desc("sequence_id")).write.mode("append").parquet(source)
        wait_for_pause(whole)
    finally:
        job.stop()
    paused = done().filter("kind = 'ended'").groupBy("series_id").agg(F.min_by(F.struct("seen", "buffered", "emitted", F.size("recent").alias("kept")), "seen").alias("p"))
    full = done().filter("kind = 'window'").groupBy("series_id").agg(
        F.count(F.lit(1)).alias("windows"), F.round(F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)), 3).alias("total")
    )
    named = [F.col(f"p.{old}").alias(new) for old, new in (("seen", "seen_at_pause"), ("buffered", "waiting_at_pause"), ("emitted", "windows_at_pause"), ("kept", "kept_at_pause"))]
    return paused.join(full, "series_id").select("series_id", *named, "windows", "total")


_ALL_BUCKETS = "SELECT event_type AS series_id, epoch_us(ts) // 1800000000 AS slot, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2"


@query(
    "S2 P10 K4",
    s.grid_sql(_ALL_BUCKETS, 1800, 1)
    + f"""
SELECT a.series_id, a.idx AS start_idx, {s.sql_stamp('any_value(a.sec)')} AS start_ts, {s.sql_stamp('max(b.sec)')} AS end_ts, sum(b.value)::BIGINT AS total
FROM points a JOIN points b ON a.series_id = b.series_id AND b.idx BETWEEN a.idx AND a.idx + 335
WHERE dayofweek(make_timestamp(a.sec * 1000000)) = 0 AND a.sec % 86400 < 60
GROUP BY a.series_id, a.idx HAVING count(*) = 336""",
)
def csv_folder_stream(spark, folder):
    """A folder of CSV files per series as streams: trim, parse, slide, gate."""
    grid = points(s.regular_windows(s.event_buckets(spark, folder), s.DAY, keep_tail=True), s.DAY)
    source = fresh_folder(spark, "csv")
    text = grid.select("series_id", F.concat(F.lit(" "), F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSS")).alias("timestamp"), F.col("value").cast("long").cast("string").alias("value"))
    text.write.partitionBy("series_id").option("header", True).csv(source)
    raw = tables.parse_fields(tables.stream_series_csv(spark, source, bytes_per_trigger=TRIGGER_BYTES, by_folder=True)).filter(~F.col("is_bad"))
    typed = raw.select("series_id", F.unix_seconds("ts").alias("sequence_id"), "ts", F.col("number").alias("value"))
    stream = window_rows(count_windows_stream(typed, 336, step=1, gate=sunday_gate("2014-08-31")))
    out = fresh_folder(spark, "sliding")
    jobs.run_to_parquet(stream, out, fresh_folder(spark, "checkpoint"))
    done = spark.read.schema(stream.schema).parquet(out)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x).cast("long")
    return done.select(
        "series_id", F.col("window_id").alias("start_idx"), s.stamp("start_ts").alias("start_ts"), s.stamp("end_ts").alias("end_ts"), total.alias("total")
    )
