"""Registered queries: grids, windows, labels, splits, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import predicates as fn
from tidemark.operators import baseline, evaluate, labels as lab, score as sc, segment, table_functions
from tidemark.operators.grid import points, regular_windows
from tidemark.plans import shared as s
from tidemark.plans.catalog import query
from tidemark.session import attach
from tidemark.sources.tables import read_table, series_summary


@query(
    "W8 A17",
    s.EVENTS_SQL.replace("WHERE idx // 48 < whole", "") + f" SELECT series_id, idx, {s.sql_stamp('sec')} AS ts, value FROM points",
)
def half_hour_grid(spark, folder):
    windows = regular_windows(s.event_buckets(spark, folder), s.DAY, keep_tail=True)
    return points(windows, s.DAY).select("series_id", "idx", s.stamp("ts").alias("ts"), "value")


@query(
    "W3 A1 F6 X8",
    s.EVENTS_SQL
    + f""" SELECT series_id, window_id, {s.sql_stamp('min(sec)')} AS start_ts, {s.sql_stamp('max(sec)')} AS end_ts,
  strftime(make_timestamp(min(sec) * 1000000), '%Y-%m-%d') AS name,
  round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value FROM points GROUP BY series_id, window_id""",
)
def daily_window_metadata(spark, folder):
    out = segment.with_metadata(s.event_windows(spark, folder))
    return out.select(
        "series_id", "window_id", s.stamp("start_ts").alias("start_ts"), s.stamp("end_ts").alias("end_ts"), "name",
        F.round("mean_value", 6).alias("mean_value"), F.round("std_value", 6).alias("std_value"),
    )


@query(
    "W4 P4",
    s.grid_sql(s.EVENT_BUCKETS, 1800, 336, 288)
    + f""" SELECT series_id, window_id, {s.sql_stamp('min(sec)')} AS start_ts,
  string_agg(value::BIGINT::VARCHAR, ',' ORDER BY pos) AS packed FROM points GROUP BY series_id, window_id""",
)
def weekly_dense_windows(spark, folder):
    out = regular_windows(s.event_buckets(spark, folder), s.WEEK)
    text = F.array_join(F.transform("values", lambda v: v.cast("long").cast("string")), ",")
    return out.select("series_id", "window_id", s.stamp("start_ts").alias("start_ts"), text.alias("packed"))


_RAW = """
WITH raw AS (
  SELECT event_type AS series_id, ts, event_id, value,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx,
    count(*) OVER (PARTITION BY event_type) AS total
  FROM events
)"""


def raw_index(spark, folder):
    rows = s.events(spark, folder).select(F.col("event_type").alias("series_id"), "ts", "event_id", "value")
    return segment.dense_index(rows, ["ts", "event_id"])


@query("F1 T1", _RAW + " SELECT series_id, event_id, idx, total FROM raw")
def event_positions(spark, folder):
    return raw_index(spark, folder).select("series_id", "event_id", "idx", "total")


@query(
    "W1 W2 W3 A1",
    _RAW
    + """ SELECT series_id, idx // 336 AS window_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_ts,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_ts, strftime(min(ts), '%Y-%m-%d') AS name,
  round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value
  FROM raw WHERE idx // 336 < total // 336 GROUP BY 1, 2""",
)
def count_windows_of_events(spark, folder):
    out = segment.window_metadata(segment.count_windows(raw_index(spark, folder), 336))
    return out.select(
        "series_id", "window_id", s.stamp("start_ts").alias("start_ts"), s.stamp("end_ts").alias("end_ts"), "name",
        F.round("mean_value", 6).alias("mean_value"), F.round("std_value", 6).alias("std_value"),
    )


_PER_PRIORITY = """
WITH first_days AS (SELECT o_orderpriority AS p, min(o_orderdate) AS d FROM orders GROUP BY 1),
kept AS (SELECT o.* FROM orders o JOIN first_days f ON o.o_orderpriority = f.p WHERE o.o_orderdate >= f.d + INTERVAL 5 DAY)"""


@query(
    "P4",
    _PER_PRIORITY
    + " SELECT o_orderpriority AS series_id, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_ts FROM kept GROUP BY 1",
)
def offset_start_filter(spark, folder):
    rows = read_table(spark, folder, "orders").select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"))
    return segment.offset_start(rows, 5).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), s.stamp(F.min("ts")).alias("first_ts"))


def raw_packed(spark, folder):
    cut = segment.count_windows(raw_index(spark, folder), 336, keep_tail=True)
    return segment.pack(cut, "ts", "value")


@query(
    "W5",
    _RAW
    + """ SELECT a.series_id, a.idx AS start_idx, strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS start_ts,
  strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS end_ts FROM raw a JOIN raw b ON a.series_id = b.series_id AND b.idx = a.idx + 335""",
)
def sliding_window_bounds(spark, folder):
    out = segment.sliding_windows(raw_packed(spark, folder), 336, with_values=False)
    return out.select("series_id", "start_idx", s.stamp("start_ts").alias("start_ts"), s.stamp("end_ts").alias("end_ts"))


@query(
    "W5 P2 P3",
    s.grid_sql(s.EVENT_BUCKETS, 1800, 1)
    + f"""
SELECT a.series_id, a.idx AS start_idx, {s.sql_stamp('any_value(a.sec)')} AS start_ts, {s.sql_stamp('max(b.sec)')} AS end_ts,
  sum(b.value)::BIGINT AS total, string_agg(b.value::BIGINT::VARCHAR, ',' ORDER BY b.idx) AS packed
FROM points a JOIN points b ON a.series_id = b.series_id AND b.idx BETWEEN a.idx AND a.idx + 335
WHERE dayofweek(make_timestamp(a.sec * 1000000)) = 0 AND a.sec % 86400 < 60
  AND a.sec >= epoch_us(TIMESTAMP '2024-01-10 00:00:00') // 1000000
GROUP BY a.series_id, a.idx HAVING count(*) = 336""",
)
def gated_sliding_windows(spark, folder):
    windows = regular_windows(s.event_buckets(spark, folder), s.GridSpec(length=336), keep_tail=True)
    stamps = F.transform(
        F.sequence(F.lit(0), F.size("values") - 1), lambda p: F.timestamp_seconds(F.unix_seconds("start_ts") + p * 1800)
    )
    out = segment.sliding_windows(windows.withColumn("stamps", stamps), 336, gate=lambda t: fn.passes_gate(t, "2024-01-10"))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x).cast("long")
    text = F.array_join(F.transform("values", lambda v: v.cast("long").cast("string")), ",")
    return out.select("series_id", "start_idx", s.stamp("start_ts").alias("start_ts"), s.stamp("end_ts").alias("end_ts"), total.alias("total"), text.alias("packed"))


@query(
    "P2 P3 X8",
    """SELECT event_id, dayofweek(ts) = 0 AS on_sunday, hour(ts) AS h, minute(ts) AS m,
  ts >= TIMESTAMP '2024-01-15' AS after_cutoff,
  coalesce(dayofweek(d) = 0 AND hour(d) = 0 AND minute(d) = 0 AND d >= TIMESTAMP '2024-01-15', true) AS day_passes,
  strftime(ts, '%A') AS day_name
FROM (SELECT event_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('day', ts) END AS d FROM events)""",
)
def alignment_gate(spark, folder):
    rows = s.events(spark, folder).select("event_id", "ts", "event_type")
    start = F.when(F.col("event_type") == "error", F.lit("no time")).otherwise(s.stamp(F.date_trunc("day", "ts")))
    return rows.select(
        "event_id",
        (F.dayofweek("ts") == 1).alias("on_sunday"),
        F.hour("ts").alias("h"),
        F.minute("ts").alias("m"),
        fn.not_before(F.col("ts"), "2024-01-15").alias("after_cutoff"),
        fn.passes_text_gate(start, "2024-01-15").alias("day_passes"),
        F.date_format("ts", "EEEE").alias("day_name"),
    )


@query(
    "P6 P7",
    """SELECT event_id, value > 60 AS is_high FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-08 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'""",
)
def ranged_fixed_threshold(spark, folder):
    rows = s.events(spark, folder).select("event_id", "ts", "value")
    return rows.filter(fn.in_range(F.col("ts"), "2024-01-08 06:00:00", "2024-01-20 18:00:00")).select(
        "event_id", (F.col("value") > 60).alias("is_high")
    )


@query(
    "P9 P12",
    _RAW
    + """, sized AS (SELECT series_id, idx // 336 AS window_id, count(*) AS n FROM raw GROUP BY 1, 2)
SELECT series_id, CASE WHEN n = 336 THEN 'accepted' ELSE 'rejected' END AS outcome, count(*) AS n FROM sized GROUP BY 1, 2""",
)
def window_shape_validation(spark, folder):
    checked = raw_packed(spark, folder).select(
        "series_id", F.when(fn.has_length(F.col("values"), 336), "accepted").otherwise("rejected").alias("outcome")
    )
    return checked.groupBy("series_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "P12 A17",
    """SELECT event_type AS series_id, CASE WHEN event_id % 7 = 3 THEN 'failed' WHEN dayofweek(ts) = 0 THEN 'scored' ELSE 'skipped' END AS outcome,
  count(*) AS n FROM events GROUP BY 1, 2""",
)
def outcome_routing(spark, folder):
    code = F.when(F.col("event_id") % 7 == 3, 500).when(F.dayofweek("ts") == 1, 200).otherwise(204)
    rows = s.events(spark, folder).select(F.col("event_type").alias("series_id"), fn.outcome(code).alias("outcome"))
    return rows.groupBy("series_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "W7",
    s.EVENTS_SQL
    + f""" SELECT w.series_id, w.window_id, p.pos, {s.sql_stamp('w.ws + 1800 * p.pos')} AS ts
FROM win w CROSS JOIN (SELECT unnest(range(0, 48))::INTEGER AS pos) p""",
)
def regenerated_timestamps(spark, folder):
    return points(s.event_windows(spark, folder), s.DAY).select("series_id", "window_id", "pos", s.stamp("ts").alias("ts"))


@query(
    "J1 X9 P5 J4",
    s.SPLIT_SQL + " SELECT series_id, window_id, name, is_anomaly, is_edge_case FROM flags",
)
def label_overlap_windows(spark, folder):
    out = lab.flag_overlap(s.event_windows(spark, folder), s.INTERVALS, s.DAY)
    out = lab.flag_edge_cases(out, s.EDGES)
    return out.select("series_id", "window_id", F.date_format("start_ts", "yyyy-MM-dd").alias("name"), "is_anomaly", "is_edge_case")


@query(
    "J1",
    s.ORDERS_SQL
    + """, spans AS (
  SELECT epoch_us(o_orderdate) // 1000000 AS ls, epoch_us(o_orderdate) // 1000000 + (CASE WHEN o_orderkey % 97 = 0 THEN 3 + o_orderkey % 40 ELSE 0 END) * 86400 AS le FROM orders
)
SELECT w.series_id, w.window_id,
  EXISTS (SELECT 1 FROM spans l WHERE w.ws <= l.le AND w.we >= l.ls
    AND ((least(l.le, w.we) - greatest(l.ls, w.ws)) // 86400 + 1) / 7.0 >= 0.3) AS is_anomaly
FROM win w""",
)
def many_intervals_overlap(spark, folder):
    """Interval set derived from the data, through the binned semi join."""
    start = F.col("o_orderdate")
    days = F.when(F.col("o_orderkey") % 97 == 0, 3 + F.col("o_orderkey") % 40).otherwise(0)
    spans = (
        read_table(spark, folder, "orders")
        .select(start.alias("start"), F.timestamp_seconds(F.unix_seconds(start) + days * 86400).alias("end"))
    )
    out = lab.flag_overlap(s.order_windows(spark, folder), spans, s.DAILY, 0.3, inline_limit=0)
    return out.select("series_id", "window_id", "is_anomaly")


_ORDERED = s.SPLIT_SQL + """,
placed AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'threshold' THEN 2 ELSE 3 END AS split_rank FROM splits),
ordered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY split_rank, window_id) - 1 AS order_id FROM placed)"""


@query("T2 U2 J4", s.SPLIT_SQL + " SELECT series_id, window_id, split, is_anomaly FROM splits")
def ordered_splits(spark, folder):
    return s.prepared(spark, folder).select("series_id", "window_id", "split", "is_anomaly")


@query(
    "J2 J3 U2",
    s.SPLIT_SQL
    + f""" SELECT series_id, window_id, name, {s.sql_stamp('ws')} AS start_ts, {s.sql_stamp('we')} AS end_ts, is_anomaly,
  round(avg(value), 6) AS mean_value FROM splits JOIN points USING (series_id, window_id) WHERE split = 'test' GROUP BY ALL""",
)
def test_window_metadata(spark, folder):
    """Metadata of the test windows: it lies on the window's own row, so no join is needed."""
    info = segment.with_metadata(s.prepared(spark, folder).filter(F.col("split") == "test"))
    return info.select(
        "series_id", "window_id", "name", s.stamp("start_ts").alias("start_ts"), s.stamp("end_ts").alias("end_ts"), "is_anomaly",
        F.round("mean_value", 6).alias("mean_value"),
    )


@query(
    "J4 U2",
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders
FROM customer""",
)
def membership_semi_anti(spark, folder):
    customers = read_table(spark, folder, "customer").select("c_custkey")
    used = read_table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    inside = customers.join(used, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True))
    outside = customers.join(used, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False))
    return inside.unionByName(outside)


@query(
    "U3",
    _ORDERED + " SELECT series_id, window_id, split, order_id * 48 + pos AS idx, round(value, 4) AS value FROM ordered JOIN points USING (series_id, window_id)",
)
def ordered_concatenation(spark, folder):
    return baseline.ordered_series(s.prepared(spark, folder), 48).select(
        "series_id", "window_id", "split", "idx", F.round("value", 4).alias("value")
    )


@query(
    "A2",
    s.ERROR_SQL + " SELECT series_id, round(mean, 8) AS mean, round(scale, 8) AS scale FROM scaler",
)
def scaler_fit(spark, folder):
    out = sc.scaler_fit(s.prepared(spark, folder), s.BY)
    return out.select("series_id", F.round("mean", 8).alias("mean"), F.round("scale", 8).alias("scale"))


@query(
    "A2 X1 J5",
    s.ERROR_SQL + " SELECT series_id, window_id, pos, round(z, 6) AS z, round(z * scale + mean, 4) AS restored FROM zp JOIN scaler USING (series_id)",
)
def scaler_roundtrip(spark, folder):
    prepared = s.prepared(spark, folder)
    params = sc.scaler_fit(prepared, s.BY)
    out = attach(prepared, params, s.BY).withColumn("z", sc.scaled("values"))
    both = out.withColumn("back", sc.unscaled("z")).select("series_id", "window_id", F.posexplode(F.arrays_zip("z", "back")).alias("pos", "_v"))
    return both.select("series_id", "window_id", "pos", F.round("_v.z", 6).alias("z"), F.round("_v.back", 4).alias("restored"))


@query(
    "A2 X1 J5",
    s.SPLIT_SQL
    + """, one AS (SELECT avg(value) AS mean, stddev_pop(value) AS scale FROM points JOIN splits USING (series_id, window_id) WHERE split = 'train')
SELECT series_id, window_id, pos, round((value - mean) / scale, 6) AS z FROM points CROSS JOIN one""",
)
def global_scaler(spark, folder):
    """One scaler for all series, applied as a scalar subquery."""
    prepared = s.prepared(spark, folder)
    out = attach(prepared, sc.scaler_fit(prepared, []), []).withColumn("z", sc.scaled("values"))
    return out.select("series_id", "window_id", F.posexplode("z").alias("pos", "z")).withColumn("z", F.round("z", 6))


@query(
    "A21",
    """SELECT event_type AS series_id, count(*) AS n_rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, min(value) AS min_value, max(value) AS max_value,
  arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value FROM events GROUP BY 1""",
)
def series_summaries(spark, folder):
    out = series_summary(s.events(spark, folder).select(F.col("event_type").alias("series_id"), "ts", "value"))
    return out.withColumn("first_ts", s.stamp("first_ts")).withColumn("last_ts", s.stamp("last_ts"))


@query(
    "T6",
    """SELECT event_type AS series_id, event_id, recency FROM (
  SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS recency FROM events) WHERE recency <= 10""",
)
def newest_rows(spark, folder):
    rows = s.events(spark, folder).select(F.col("event_type").alias("series_id"), "event_id")
    return evaluate.newest(rows, 10, "event_id")


@query(
    "T7",
    s.SPLIT_SQL
    + """ SELECT series_id, min(window_id) FILTER (WHERE NOT is_anomaly) AS first_normal,
  min(window_id) FILTER (WHERE is_anomaly) AS first_anomaly FROM flags GROUP BY 1""",
)
def exemplar_windows(spark, folder):
    return evaluate.exemplars(lab.flag_overlap(s.event_windows(spark, folder), s.INTERVALS, s.DAY))


@query(
    "D2 W1 T1",
    """WITH raw AS (SELECT event_type AS series_id, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx FROM events)
SELECT series_id, idx // 96 AS window_id, strftime(arg_min(ts, idx), '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(arg_max(ts, idx), '%Y-%m-%d %H:%M:%S') AS end_ts,
  round(sum(value), 3) AS total FROM raw GROUP BY 1, 2 HAVING count(*) = 96""",
)
def windows_by_table_function(spark, folder):
    """Count windows by a table function called from SQL, with blocks of a series as partitions."""
    table_functions.register(spark)
    events = s.events(spark, folder).select(F.col("event_type").alias("series_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    rows = table_functions.numbered(events, ["event_id"], 96)
    return spark.sql(
        """SELECT series_id, window_id, date_format(start_ts, 'yyyy-MM-dd HH:mm:ss') AS start_ts, date_format(end_ts, 'yyyy-MM-dd HH:mm:ss') AS end_ts,
  round(aggregate(values, 0D, (a, x) -> a + x), 3) AS total
FROM count_windows(TABLE({rows}) PARTITION BY (series_id, block) ORDER BY (idx), 96)""",
        rows=rows,
    )
