"""Registered queries: analytic functions, smoothing baseline, comparison, messages, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import predicates as fn
from tidemark.operators import baseline, calibrate as cal, evaluate as ev
from tidemark.operators.grid import points
from tidemark.operators.segment import dense_index
from tidemark.plans import flows, shared as s
from tidemark.plans.catalog import query
from tidemark.plans.queries_scores import _COUNTS, _METRIC, rounded_metrics
from tidemark.session import attach, fresh_folder, settle
from tidemark.sources import messages as msg
from tidemark.sources.tables import parse_fields, read_series_csv, read_table


def order_points(spark, folder):
    return points(s.order_windows(spark, folder), s.DAILY)


def event_points(spark, folder):
    return points(s.event_windows(spark, folder), s.DAY)


@query(
    "F2",
    s.ORDERS_SQL + " SELECT series_id, idx, coalesce(lag(value) OVER (PARTITION BY series_id ORDER BY idx), value) AS forecast FROM points",
)
def one_step_forecast(spark, folder):
    return baseline.one_step_forecast(order_points(spark, folder), block=512).select("series_id", "idx", "forecast")


@query(
    "F8",
    s.ORDERS_SQL
    + """ SELECT series_id, idx, round(avg(value) OVER f, 6) AS rolling_mean, round(stddev_samp(value) OVER f, 6) AS rolling_std,
  round(abs(value - avg(value) OVER f), 6) AS deviation, value - lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS diff
FROM points WINDOW f AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def rolling_features(spark, folder):
    out = baseline.rolling_features(order_points(spark, folder), block=512)
    return out.select("series_id", "idx", *[F.round(c, 6).alias(c) for c in ("rolling_mean", "rolling_std", "deviation")], "diff")


@query(
    "F5",
    s.ORDERS_SQL
    + """ SELECT * FROM (SELECT series_id, idx, sum(value) OVER f AS moving_sum, round(avg(value) OVER f, 6) AS moving_mean, max(value) OVER f AS moving_max,
  count(*) OVER f AS n FROM points WINDOW f AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) WHERE n = 12""",
)
def moving_stats(spark, folder):
    out = baseline.moving_stats(order_points(spark, folder), 12, block=512)
    return out.select("series_id", "idx", "moving_sum", F.round("moving_mean", 6).alias("moving_mean"), "moving_max", F.lit(12).alias("n"))


@query("F4", s.ORDERS_SQL + " SELECT series_id, idx, sum(value) OVER (PARTITION BY series_id ORDER BY idx) AS running_sum FROM points")
def prefix_sums(spark, folder):
    return baseline.prefix_sum(order_points(spark, folder), block=512).select("series_id", "idx", "running_sum")


_EWM = """,
{name} AS (
  SELECT series_id, idx, value AS num, 1.0::DOUBLE AS den FROM {src} WHERE idx = 0
  UNION ALL
  SELECT p.series_id, p.idx, p.value + e.num * (47.0 / 49.0)::DOUBLE, 1.0 + e.den * (47.0 / 49.0)::DOUBLE
  FROM {name} e JOIN {src} p ON p.series_id = e.series_id AND p.idx = e.idx + 1
)"""


@query("F3", s.ORDERS_SQL + _EWM.format(name="ewm", src="points") + " SELECT series_id, idx, round(num / den, 6) AS smoothed FROM ewm")
def exponential_smoothing(spark, folder):
    out = baseline.exponential_smoothing(order_points(spark, folder))
    return out.select("series_id", "idx", F.round("smoothed", 6).alias("smoothed"))


_SES = (
    s.SPLIT_SQL
    + """,
placed AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'threshold' THEN 2 ELSE 3 END AS split_rank FROM splits),
ordered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY split_rank, window_id) - 1 AS order_id FROM placed),
line AS (SELECT series_id, window_id, split, is_anomaly, order_id * 48 + pos AS idx, value FROM ordered JOIN points USING (series_id, window_id))"""
    + _EWM.format(name="ewm", src="line")
    + """,
ses AS (
  SELECT l.series_id, l.window_id, l.is_anomaly, avg(pow(l.value - coalesce(e.num / e.den, l.value), 2)) AS score
  FROM line l LEFT JOIN ewm e ON e.series_id = l.series_id AND e.idx = l.idx - 1 WHERE l.split = 'test' GROUP BY 1, 2, 3
)"""
)


@query("M6 F2 F3 A16 U3", _SES + " SELECT series_id, window_id, is_anomaly, round(score, 4) AS score FROM ses")
def smoothing_scores(spark, folder):
    out = baseline.smoothing_scores(s.prepared(spark, folder), 48)
    return out.withColumn("score", F.round("score", 4))


_SES_BEST = (
    _SES
    + """,
span2 AS (SELECT series_id, min(score) AS lo, max(score) AS hi FROM ses GROUP BY 1),
cand AS (SELECT series_id, i AS cut, CASE WHEN i = 499 THEN hi ELSE i * ((hi - lo) / 499) + lo END AS t FROM span2 CROSS JOIN (SELECT unnest(range(0, 500)) AS i)),
tries AS (
  SELECT c.series_id, cut, t, count(*) FILTER (WHERE (score > t) = is_anomaly) AS correct
  FROM cand c JOIN ses ON ses.series_id = c.series_id GROUP BY 1, 2, 3
),
best AS (SELECT series_id, max(correct) AS correct, arg_max(t, row(correct, -cut)) AS threshold FROM tries GROUP BY 1)"""
)


@query("M6 J7 T4", _SES_BEST + " SELECT series_id, correct, round(threshold, 4) AS threshold FROM best")
def smoothing_best_threshold(spark, folder):
    pool = settle(baseline.smoothing_scores(s.prepared(spark, folder), 48)).df
    out = cal.best_accuracy(pool, s.BY)
    return out.select("series_id", "correct", F.round("threshold", 4).alias("threshold"))


@query(
    "M16 A9 A10 A20",
    s.POINT_SQL
    + _SES_BEST[len(s.SPLIT_SQL):]
    + f""",
both_methods AS (
  SELECT 'smoothing' AS method, series_id, is_anomaly, score > threshold AS is_flagged FROM ses JOIN best USING (series_id)
  UNION ALL
  SELECT 'profile', series_id, is_anomaly, is_flagged FROM wpoint WHERE split = 'test'
),
c AS (SELECT method, {_COUNTS} FROM both_methods GROUP BY 1)
SELECT *, {_METRIC} FROM c""",
)
def detector_comparison(spark, folder):
    """Two detectors side by side on the same test windows."""
    windows = s.prepared(spark, folder)
    ses = settle(baseline.smoothing_scores(windows, 48)).df
    best = cal.best_accuracy(ses, s.BY).select("series_id", "threshold")
    first = attach(ses, best, s.BY).select(F.lit("smoothing").alias("method"), "is_anomaly", (F.col("score") > F.col("threshold")).alias("is_flagged"))
    params = flows.fit_profile_model(windows, s.DAY, s.POINT, s.BY)
    second = flows.score_windows(windows.filter(F.col("split") == "test"), params, s.POINT, s.BY)
    both = first.unionByName(second.select(F.lit("profile").alias("method"), "is_anomaly", "is_flagged"))
    return rounded_metrics(ev.metrics(ev.confusion(both, ["method"])))


@query(
    "A14 J8",
    s.EVENTS_SQL
    + """, st AS (SELECT series_id, list(value - m ORDER BY idx) AS v, count(*) AS n FROM points JOIN (SELECT series_id, avg(value) AS m FROM points GROUP BY 1) USING (series_id) GROUP BY 1)
SELECT series_id, lag, round(list_dot_product(v[1:n - lag], v[lag + 1:n]) / list_dot_product(v, v), 6) AS acf
FROM st CROSS JOIN (SELECT unnest(range(0, 672)) AS lag)""",
)
def autocorrelation(spark, folder):
    out = baseline.autocorrelation(event_points(spark, folder), 672, block=768)
    return out.select("series_id", "lag", F.round("acf", 6).alias("acf"))


@query(
    "X14 X8",
    """SELECT event_id, round(sin(2 * pi() * ((dayofweek(ts) + 6) % 7) / 7), 9) AS dow_sin, round(cos(2 * pi() * ((dayofweek(ts) + 6) % 7) / 7), 9) AS dow_cos,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events""",
)
def calendar_features(spark, folder):
    sin, cos = fn.weekday_cycle(F.col("ts"))
    return s.events(spark, folder).select(
        "event_id", F.round(sin, 9).alias("dow_sin"), F.round(cos, 9).alias("dow_cos"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso")
    )


@query(
    "X13",
    s.EVENTS_SQL + " SELECT series_id, window_id, 47 - pos AS pos, value FROM points",
)
def reversed_windows(spark, folder):
    out = s.event_windows(spark, folder)
    return out.select("series_id", "window_id", F.posexplode(F.reverse("values")).alias("pos", "value"))


@query(
    "X11",
    s.EVENTS_SQL
    + """ SELECT series_id, window_id, 48 AS n, sum(CASE WHEN pos = 5 THEN 0 ELSE value END)::BIGINT AS total, count(CASE WHEN pos = 5 THEN NULL ELSE 1 END) AS parsed
FROM points GROUP BY 1, 2""",
)
def list_text_cleanup(spark, folder):
    """Vectors written as ``"[a, b, ...]"`` and read back; position 5 is made unreadable."""
    text = F.concat(F.lit("["), F.array_join(F.transform("values", lambda v, i: F.when(i == 5, "n/a").otherwise(v.cast("string"))), ", "), F.lit("]"))
    parsed = s.event_windows(spark, folder).withColumn("v", fn.list_text(text))
    good = F.filter("v", lambda x: x.isNotNull())
    return parsed.select(
        "series_id", "window_id", F.size("v").alias("n"), F.aggregate(good, F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"), F.size(good).alias("parsed")
    )


@query(
    "X10",
    s.EVENTS_SQL
    + f""" SELECT series_id, window_id, {s.sql_stamp('min(sec)')} AS window_start, sum(value)::BIGINT AS total, count(*) AS n FROM points GROUP BY 1, 2""",
)
def json_windows(spark, folder):
    """Request bodies encoded as JSON, decoded again with a fixed schema."""
    out = s.event_windows(spark, folder)
    sent = out.select("series_id", "window_id", msg.encode_request(F.col("values"), s.stamp("start_ts"), s.stamp("end_ts")).alias("body"))
    got = sent.withColumn("request", msg.decode_request(F.col("body")))
    return got.select(
        "series_id", "window_id", F.get_json_object("body", "$.window_start").alias("window_start"),
        F.aggregate("request.values", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"), F.size("request.values").alias("n"),
    )


@query(
    "P10 S2",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS number, event_type = 'error' AS is_bad FROM events""",
)
def trim_and_parse(spark, folder):
    text = F.when(F.col("event_type") == "error", " n/a ").otherwise(F.concat(F.lit("  "), F.col("value").cast("string"), F.lit(" ")))
    rows = s.events(spark, folder).select("event_id", F.concat(F.lit(" "), s.stamp("ts")).alias("timestamp"), text.alias("value"))
    return parse_fields(rows).select("event_id", "number", "is_bad")


@query(
    "S4 X10",
    """SELECT event_id::VARCHAR AS key, '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","value":' || trunc(value)::BIGINT ||
  ',"produced_at":"2024-02-01T00:00:00","sequence_id":' || event_id || '}' AS value FROM events""",
)
def encoded_messages(spark, folder):
    rows = s.events(spark, folder).select("ts", "value", F.col("event_id").alias("sequence_id"))
    return msg.encode(rows, produced_at=F.lit("2024-02-01T00:00:00"))


@query(
    "P1 K1",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts,
  CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE trunc(value)::BIGINT END AS value,
  CASE WHEN event_type = 'error' THEN NULL ELSE event_id END AS sequence_id, event_type = 'error' AS is_reject FROM events""",
)
def decoded_messages(spark, folder):
    """Malformed text gives a null row, a fractional value a null field; neither is an error."""
    rows = s.events(spark, folder).select("event_id", "event_type", "ts", "value", F.col("event_id").alias("sequence_id"))
    good = msg.message_json(produced_at=F.lit("2024-02-01T00:00:00"))
    fractional = F.concat(F.lit('{"timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('","value":1.5,"sequence_id":'), F.col("sequence_id").cast("string"), F.lit("}"))
    text = F.when(F.col("event_type") == "error", "{bad").when(F.col("event_type") == "view", fractional).otherwise(good)
    out = msg.decode(rows.select("event_id", text.cast("binary").alias("value")), keep=("event_id",))
    return out.select("event_id", s.stamp("ts").alias("ts"), "value", "sequence_id", "is_reject")


@query(
    "S5 S6",
    """WITH raw AS (SELECT event_type AS series_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx,
  count(*) OVER (PARTITION BY event_type) AS total FROM events)
SELECT series_id, event_id, k * (total - 500) + idx - 500 AS sequence_id FROM raw CROSS JOIN (VALUES (0), (1), (2)) r(k) WHERE idx >= 500""",
)
def replayed_messages(spark, folder):
    """Skip the first 500 rows of every series, replay three times; sequence ids keep rising."""
    rows = s.events(spark, folder).select(F.col("event_type").alias("series_id"), "event_id")
    return msg.replay(msg.skip_start(dense_index(rows, ["event_id"]), 500), 3).select("series_id", "event_id", "sequence_id")


@query(
    "S1 T1",
    """SELECT 'orders' AS series_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2""",
)
def csv_series_scan(spark, folder):
    """A series written as header CSV and scanned back with its fixed schema."""
    path = fresh_folder(spark, "csv")
    daily = read_table(spark, folder, "orders").groupBy(F.col("o_orderdate").alias("timestamp")).agg(F.count(F.lit(1)).alias("value"))
    daily.select(s.stamp("timestamp").alias("timestamp"), "value").write.option("header", True).csv(path)
    return read_series_csv(spark, path, "orders").select("series_id", s.stamp("ts").alias("ts"), "value")


@query(
    "P8 K10",
    s.POINT_SQL
    + s.POINT_AND_WINDOW
    + f""" SELECT is_flagged::VARCHAR AS is_anomaly, round(window_score, 3)::VARCHAR AS anomaly_score, round(t.threshold, 2)::DECIMAL(18, 2)::VARCHAR AS threshold,
  {s.sql_stamp('ws')} AS window_start, {s.sql_stamp('we')} AS window_end
FROM wpoint JOIN wthr t USING (series_id) WHERE split = 'test'""",
)
def formatted_results(spark, folder):
    """Result rows as text, five named fields."""
    windows = s.prepared(spark, folder)
    params = flows.fit_profile_model(windows, s.DAY, s.POINT, s.BY)
    replies = flows.detect(windows.filter(F.col("split") == "test"), params, s.DAY, s.POINT, s.BY)
    rounded = replies.withColumn("anomaly_score", F.round("anomaly_score", 3)).withColumn("threshold", F.round("threshold", 2).cast("decimal(18,2)"))
    return msg.format_results(rounded)
