import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import dense
from tidemark.config import GridSpec, ScorerSpec
from tidemark.functions import predicates as fn
from tidemark.operators import segment
from tidemark.operators.grid import bucket, points, regular_windows
from tidemark.plans import flows
from tidemark.sources import messages as msg
from tidemark.sources import tables
from tidemark.streaming import jobs
from tidemark.streaming.windows import count_windows_stream, deduplicated, rejected_rows, sunday_gate, window_rows


def numbered(regular):
    return segment.dense_index(regular, ["ts"]).select("series_id", F.col("idx").alias("sequence_id"), "ts", "value")


def add_file(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder, schema, per_trigger=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def test_tumbling_equals_batch_over_split_files_and_restart(spark, regular, tmp_path):
    rows = numbered(regular).unionByName(numbered(regular).withColumn("series_id", F.lit("b"))).cache()
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    # Cuts inside windows; the second file is the start of a second run from the same checkpoint.
    for lo, hi in ((0, 500), (500, 2117)):
        add_file(rows.filter(f"sequence_id >= {lo} and sequence_id < {hi}"), src)

    def run():
        jobs.run_to_parquet(window_rows(count_windows_stream(stream_of(spark, src, rows.schema), 336, drop_late=True)), out, chk)

    run()
    add_file(rows.filter("sequence_id >= 2117 and sequence_id < 10320"), src)
    # A replayed part must not count twice.
    add_file(rows.filter("sequence_id >= 10000"), src)
    run()
    got = sorted(map(tuple, spark.read.parquet(out).select("series_id", "window_id", "start_ts", "end_ts", "values").collect()))
    batch = segment.pack(segment.count_windows(segment.dense_index(rows, ["sequence_id"]), 336), "ts", "value")
    want = sorted(map(tuple, batch.select("series_id", "window_id", "start_ts", "end_ts", "values").collect()))
    assert got == want and len(got) == 60


def test_sliding_gate_equals_batch(spark, regular, tmp_path):
    rows = numbered(segment.offset_start(regular, 5))
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    for lo, hi in ((0, 335), (335, 4000), (4000, 20000)):
        add_file(rows.filter(f"sequence_id >= {lo} and sequence_id < {hi}"), src)
    full = count_windows_stream(stream_of(spark, src, rows.schema), 336, step=1, gate=sunday_gate("2014-08-31"), with_status=True)
    jobs.run_to_parquet(full, out, chk)
    done = spark.read.schema(full.schema).parquet(out)
    got = sorted((r["window_id"], r["start_ts"], r["values"]) for r in window_rows(done).collect())
    packed = segment.pack(segment.count_windows(segment.dense_index(rows, ["ts"]), 336, keep_tail=True), "ts", "value")
    batch = segment.sliding_windows(packed, 336, gate=fn.passes_gate)
    assert got == sorted((r["start_idx"], r["start_ts"], r["values"]) for r in batch.collect()) and len(got) == 22
    last = done.filter("kind = 'buffering'").orderBy(F.desc("seen")).first()
    assert (last["seen"], last["emitted"], last["skipped"], last["buffered"]) == (10080, 22, 9745 - 22, 335)


def test_idle_series_ends(spark, tmp_path):
    rows = spark.range(10).selectExpr("'a' series_id", "id sequence_id", "timestamp_seconds(id * 1800) ts", "cast(id as double) value")
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    add_file(rows, src)
    stream = jobs.observed(count_windows_stream(stream_of(spark, src, rows.schema), 4, idle_seconds=2))
    totals = jobs.Totals()
    spark.streams.addListener(totals)
    query = jobs.start(stream.writeStream.format("parquet").option("path", out), chk, every="1 second")
    try:
        deadline = time.time() + 60
        ended = 0
        while time.time() < deadline and not ended:
            time.sleep(2)
            ended = spark.read.schema(stream.schema).parquet(out).filter("kind = 'ended'").count() if (tmp_path / "out").exists() else 0
        # Rows that come after the pause go on with the rows that wait.
        add_file(rows.selectExpr("series_id", "sequence_id + 10 sequence_id", "ts", "value"), src)
        while time.time() < deadline and spark.read.schema(stream.schema).parquet(out).filter("kind = 'window'").count() < 5:
            time.sleep(1)
        key = str(query.id)
    finally:
        query.stop()
        spark.streams.removeListener(totals)
    windows = spark.read.schema(stream.schema).parquet(out).filter("kind = 'window'").orderBy("window_id").collect()
    assert [r["window_id"] for r in windows] == [0, 1, 2, 3, 4] and windows[2]["values"] == [8.0, 9.0, 0.0, 1.0]
    row = spark.read.schema(stream.schema).parquet(out).filter("kind = 'ended'").orderBy("seen").first()
    assert (row["seen"], row["emitted"], row["buffered"]) == (10, 2, 2)
    assert totals.rows[key] == 20 and totals.last[key]["total"] == 20


def test_late_rows_keep_their_place_and_are_counted(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    rows = spark.range(96).selectExpr("'a' series_id", "id sequence_id", "timestamp_seconds(id * 1800) ts", "cast(id as double) value")
    nulls = rows.limit(2).selectExpr("series_id", "cast(null as bigint) sequence_id", "ts", "value")
    add_file(rows.filter("sequence_id >= 48").unionByName(nulls), src)
    time.sleep(1)
    add_file(rows.filter("sequence_id < 48"), src)
    stream = count_windows_stream(stream_of(spark, src, rows.schema), 24, with_status=True)
    jobs.run_to_parquet(stream, out, chk)
    done = spark.read.schema(stream.schema).parquet(out)
    last = done.filter("kind = 'buffering'").orderBy(F.desc("seen")).first()
    assert (last["seen"], last["late"], last["emitted"]) == (96, 48, 4)
    firsts = [r["values"][0] for r in done.filter("kind = 'window'").orderBy("window_id").collect()]
    assert firsts == [48.0, 72.0, 0.0, 24.0]
    assert rejected_rows(spark.read.parquet(src)).count() == 2


def test_csv_folder_to_json_results(spark, regular, tmp_path):
    """Directory of CSV files to sliding windows, gate, scores and formatted JSON rows."""
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    daily = regular.filter("ts >= '2014-07-06'").withColumn("value", F.when(F.col("ts").between("2014-09-08", "2014-09-09"), 500.0).otherwise(F.col("value")))
    text = daily.orderBy("ts").select(F.concat(F.lit(" "), F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSS")).alias("timestamp"), F.col("value").cast("int").cast("string").alias("value"))
    text.coalesce(1).write.option("header", True).csv(src)
    spec = GridSpec(offset_days=0)
    train = regular_windows(bucket(daily.filter("ts < '2014-09-07'"), "series_id", "ts", 1800, F.sum("value")), spec)
    split = F.when(F.col("window_id") < 4, "train").when(F.col("window_id") < 6, "val").otherwise("threshold")
    noisy = train.withColumn("values", F.transform("values", lambda v, i: v + F.sin(i * (F.col("window_id") + 1)))).withColumn("split", split)
    scorer = ScorerSpec(mode="window", percentile=99.99)
    params = flows.fit_profile_model(noisy.withColumn("series_id", F.lit("csv")), spec, scorer, ["series_id"])
    rows = tables.stream_series_csv(spark, src, "*.csv").withColumn("series_id", F.lit("csv"))
    typed = tables.parse_fields(rows).filter(~F.col("is_bad")).select(
        "series_id", F.unix_seconds("ts").alias("sequence_id"), "ts", F.col("number").alias("value")
    )
    windows = count_windows_stream(typed, 336, step=1, gate=sunday_gate("2014-08-31"))
    jobs.detect_stream(windows, params, spec, scorer, ["series_id"], out, chk).awaitTermination()
    results = spark.read.json(f"{out}/formatted").collect()
    assert len(results) == 22 and {r["is_anomaly"] for r in results} <= {"true", "false"}
    flagged = spark.read.parquet(f"{out}/flagged").orderBy("window_start").collect()
    hit = [r for r in flagged if str(r["window_start"]).startswith("2014-09-07")]
    assert hit and str(hit[0]["localization"]["anomaly_start"]).startswith(("2014-09-07", "2014-09-08")) and len(hit[0]["points"]) == 3


def test_batch_folders_are_idempotent(spark, tmp_path):
    df = spark.range(5)
    for _ in range(2):
        jobs.write_batch(df, str(tmp_path), 7)
    assert spark.read.parquet(str(tmp_path)).count() == 5


def test_deduplication_within_watermark(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    rows = spark.range(6).selectExpr("'a' series_id", "id % 3 sequence_id", "timestamp_seconds(1404172800 + id % 3) ts", "1.0D value")
    add_file(rows, src)
    jobs.run_to_parquet(deduplicated(stream_of(spark, src, rows.schema)), out, chk)
    assert spark.read.parquet(out).count() == 3


def test_messages_round_trip(spark):
    rows = spark.range(3).selectExpr("id sequence_id", "timestamp_seconds(1404172800 + id * 1800) ts", "id + 0.9D value")
    encoded = msg.encode(rows, F.lit("2014-07-01T00:00:00"))
    assert encoded.orderBy("key").first()["key"] == "0"
    back = msg.decode(encoded).orderBy("sequence_id").collect()
    assert [(r["sequence_id"], r["value"], r["is_reject"]) for r in back] == [(0, 0, False), (1, 1, False), (2, 2, False)]
    odd = spark.createDataFrame([("{bad",), ('{"value": 1.5, "sequence_id": 4}',), ('{"timestamp": "never", "value": 2}',)], "value string")
    got = {(r["value"], r["sequence_id"], r["ts"], r["is_reject"]) for r in msg.decode(odd).collect()}
    assert got == {(None, None, None, True), (None, 4, None, False), (2, None, None, False)}


def test_replay_keeps_sequence_ids_rising(spark):
    rows = spark.range(5).selectExpr("'a' series_id", "timestamp_seconds(id) ts", "id")
    indexed = segment.dense_index(rows, ["ts", "id"])
    out = msg.replay(msg.skip_start(indexed, 2), 2).orderBy("sequence_id").collect()
    assert [(r["sequence_id"], r["id"]) for r in out] == [(0, 2), (1, 3), (2, 4), (3, 2), (4, 3), (5, 4)]
    assert msg.skip_start(indexed, 5).count() == 0


def test_csv_scan(spark, tmp_path):
    (tmp_path / "s.csv").write_text("timestamp,value\n2014-07-01 00:00:00,10844\n2014-07-01 00:30:00,8127\n")
    assert [(str(r["ts"]), r["value"]) for r in tables.read_series_csv(spark, str(tmp_path / "s.csv")).orderBy("ts").collect()][1] == ("2014-07-01 00:30:00", 8127.0)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_series_csv(spark, str(tmp_path / "none.csv"))


def test_gate_vector_equals_column_gate(spark):
    us = np.arange(0, 40 * 48, dtype="int64") * 1_800_000_000 + 1_409_011_200_000_000
    df = spark.createDataFrame([(int(u),) for u in us], "us long").select(F.timestamp_micros("us").alias("t"))
    want = [r[0] for r in df.select(fn.passes_gate(F.col("t"))).collect()]
    assert list(sunday_gate("2014-08-31")(us)) == want


def test_points_of_windows(spark):
    out = points(dense(spark, [[1.0, 2.0], [3.0, 4.0]]), GridSpec(length=2)).orderBy("idx").collect()
    assert [(r["idx"], r["value"], str(r["ts"])[11:16]) for r in out] == [(0, 1, "00:00"), (1, 2, "00:30"), (2, 3, "01:00"), (3, 4, "01:30")]


def test_chained_queries_survive_stops_and_stray_files(spark, regular, tmp_path):
    """The first query is stopped between triggers and restarted; a file that its log does not name is not read by the second."""
    rows = numbered(regular).filter("sequence_id < 3360").cache()
    src, mid, out, one, two = (str(tmp_path / n) for n in ("src", "mid", "out", "one", "two"))
    for lo in range(0, 3360, 560):
        add_file(rows.filter(f"sequence_id >= {lo} and sequence_id < {lo + 560}"), src)
    schema = "series_id string, window_id long, total double"

    def first(every=None):
        windows = window_rows(count_windows_stream(stream_of(spark, src, rows.schema), 336, drop_late=True))
        total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")
        return jobs.run_to_json(windows.select("series_id", "window_id", total), mid, one, every)

    def second():
        jobs.run_to_parquet(jobs.follow_json(spark, mid, schema, 1), out, two)

    with pytest.raises(ValueError, match="no log"):
        jobs.follow_json(spark, mid, schema)
    job = first("100 milliseconds")
    while not job.lastProgress or job.lastProgress.batchId < 1:
        time.sleep(0.1)
    job.stop()
    (tmp_path / "mid" / "part-stray.json").write_text('{"series_id": "a", "window_id": 99, "total": 1.0}\n')
    second()
    some = spark.read.schema(schema).parquet(out).count()
    first().awaitTermination()
    second()
    second()
    got = sorted(map(tuple, spark.read.schema(schema).parquet(out).collect()))
    assert got == [("a", w, float(7 * sum(range(48)))) for w in range(10)] and some <= 10
