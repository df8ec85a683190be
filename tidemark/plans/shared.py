"""Series and settings the registered queries share, and the matching SQL parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import GridSpec, ScorerSpec, SplitSpec
from tidemark.operators.grid import bucket, regular_windows
from tidemark.operators.labels import flag_edge_cases, flag_overlap
from tidemark.plans import flows
from tidemark.sources.tables import read_table

DAY = GridSpec(length=48)
WEEK = GridSpec(length=336, offset_days=6)
DAILY = GridSpec(step_seconds=86400, length=7)
SPLITS = SplitSpec(train=6, val=2, threshold=2)
POINT = ScorerSpec()
WINDOW = ScorerSpec(mode="window", percentile=99.99)
BY = ["series_id"]

INTERVALS = [
    ("2024-01-08 06:00:00", "2024-01-08 20:30:00", "one day"),
    ("2024-01-15 20:00:00", "2024-01-17 03:30:00", "three days"),
    ("2024-01-21 22:00:00", "2024-01-22 02:00:00", "around midnight"),
    ("2024-01-27 12:00:00", "2024-01-27 18:00:00", "afternoon"),
]
EDGES = ("2024-01-19", "2024-01-25")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events")


def event_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return bucket(events(spark, folder), "event_type", "ts", 1800)


def value_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return bucket(events(spark, folder), "event_type", "ts", 1800, F.sum("value"))


def order_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return bucket(read_table(spark, folder, "orders"), "o_orderpriority", "o_orderdate", 86400)


def ship_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return bucket(read_table(spark, folder, "lineitem"), "l_returnflag", "l_shipdate", 86400, F.sum("l_quantity"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return regular_windows(event_buckets(spark, folder), DAY)


def order_windows(spark: SparkSession, folder: str) -> DataFrame:
    return regular_windows(order_buckets(spark, folder), DAILY)


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled, split daily windows of the half-hourly value totals."""
    return flows.prepare(value_buckets(spark, folder), INTERVALS, DAY, SPLITS, EDGES)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """The same windows without splits."""
    windows = regular_windows(value_buckets(spark, folder), DAY)
    return flag_edge_cases(flag_overlap(windows, INTERVALS, DAY), EDGES)


def stamp(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


# --- SQL parts -----------------------------------------------------------------

STAMP = "strftime(make_timestamp({0} * 1000000), '%Y-%m-%d %H:%M:%S')"


def sql_stamp(seconds: str) -> str:
    return STAMP.format(f"({seconds})")


def sql_percentile(p: str, ordered: str = "s") -> str:
    """Linear interpolation in a sorted list that returns equal neighbours unchanged."""
    rank = f"((len({ordered}) - 1) * ({p})::DOUBLE)"
    low, high = f"{ordered}[floor({rank})::BIGINT + 1]", f"{ordered}[ceil({rank})::BIGINT + 1]"
    return f"({low} + ({high} - {low}) * ({rank} - floor({rank})))"


def grid_sql(buckets: str, step: int, length: int, offset: int = 0) -> str:
    return f"""
WITH RECURSIVE buckets AS ({buckets}),
span AS (SELECT series_id, min(slot) + {offset} AS lo, max(slot) AS hi FROM buckets GROUP BY series_id),
grid AS (
  SELECT g.series_id, g.slot, g.slot - g.lo AS idx, g.slot * {step} AS sec, coalesce(b.value, 0.0)::DOUBLE AS value, g.whole
  FROM (SELECT series_id, unnest(generate_series(lo, hi)) AS slot, lo, (hi - lo + 1) // {length} AS whole FROM span) g
  LEFT JOIN buckets b ON b.series_id = g.series_id AND b.slot = g.slot
),
points AS (
  SELECT series_id, idx // {length} AS window_id, (idx % {length})::INTEGER AS pos, idx, sec, value
  FROM grid WHERE idx // {length} < whole
),
win AS (SELECT series_id, window_id, min(sec) AS ws, max(sec) AS we FROM points GROUP BY series_id, window_id)"""


EVENT_BUCKETS = "SELECT event_type AS series_id, epoch_us(ts) // 1800000000 AS slot, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2"
VALUE_BUCKETS = EVENT_BUCKETS.replace("count(*)::DOUBLE", "sum(value)")
ORDER_BUCKETS = "SELECT o_orderpriority AS series_id, epoch_us(o_orderdate) // 86400000000 AS slot, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2"
SHIP_BUCKETS = "SELECT l_returnflag AS series_id, epoch_us(l_shipdate) // 86400000000 AS slot, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY 1, 2"

EVENTS_SQL = grid_sql(EVENT_BUCKETS, 1800, 48)
VALUES_SQL = grid_sql(VALUE_BUCKETS, 1800, 48)
ORDERS_SQL = grid_sql(ORDER_BUCKETS, 86400, 7)
SHIPS_SQL = grid_sql(SHIP_BUCKETS, 86400, 7)

_VALUES = ", ".join(
    f"(epoch_us(TIMESTAMP '{a}') // 1000000, epoch_us(TIMESTAMP '{b}') // 1000000)" for a, b, _ in INTERVALS
)
_EDGES = ", ".join(f"'{e}'" for e in EDGES)

SPLIT_SQL = (
    VALUES_SQL
    + f""",
labels_iv(ls, le) AS (VALUES {_VALUES}),
flags AS (
  SELECT w.*, strftime(make_timestamp(ws * 1000000), '%Y-%m-%d') AS name,
    EXISTS (SELECT 1 FROM labels_iv l WHERE w.ws <= l.le AND w.we >= l.ls
            AND ((least(l.le, w.we) - greatest(l.ls, w.ws)) // 1800 + 1) / 48.0 >= 0.10) AS is_anomaly,
    strftime(make_timestamp(ws * 1000000), '%Y-%m-%d') IN ({_EDGES}) AS is_edge_case
  FROM win w
),
ranked AS (
  SELECT *, sum(CASE WHEN is_anomaly THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY window_id) AS rn FROM flags
),
splits AS (
  SELECT * EXCLUDE (rn), rn,
    CASE WHEN is_anomaly OR rn > {SPLITS.used} THEN 'test' WHEN rn <= {SPLITS.train} THEN 'train'
         WHEN rn <= {SPLITS.train + SPLITS.val} THEN 'val' ELSE 'threshold' END AS split
  FROM ranked
)"""
)

ERROR_SQL = (
    SPLIT_SQL
    + """,
scaler AS (
  SELECT series_id, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale
  FROM points JOIN splits USING (series_id, window_id) WHERE split = 'train' GROUP BY series_id
),
zp AS (
  SELECT p.*, s.split, s.is_anomaly, s.is_edge_case, s.ws, s.we, (p.value - c.mean) / c.scale AS z
  FROM points p JOIN splits s USING (series_id, window_id) JOIN scaler c USING (series_id)
),
profile AS (SELECT series_id, pos, avg(z) AS x_hat FROM zp WHERE split = 'train' GROUP BY series_id, pos),
errs AS (SELECT zp.*, x_hat, abs(z - x_hat) AS err FROM zp JOIN profile USING (series_id, pos))"""
)

POINT_SQL = (
    ERROR_SQL
    + f""",
pfit AS (SELECT series_id, avg(err) AS mu, var_pop(err) + 1e-6 AS v FROM errs WHERE split = 'val' GROUP BY series_id),
ps AS (SELECT errs.*, pow(err - mu, 2) / v AS score FROM errs JOIN pfit USING (series_id)),
thr AS (
  SELECT series_id, {sql_percentile("0.95")} AS tau
  FROM (SELECT series_id, list_sort(list(score)) AS s FROM ps WHERE split = 'threshold' GROUP BY series_id)
),
wpoint AS (
  SELECT series_id, window_id, split, is_anomaly, is_edge_case, ws, we, max(score) AS window_score,
    count(*) FILTER (WHERE score > tau) AS n_over, count(*) FILTER (WHERE score > tau) >= 5 AS is_flagged
  FROM ps JOIN thr USING (series_id) GROUP BY ALL
)"""
)


# Two fit windows: the covariance is one outer product, so the inverse is closed form.
def window_part(percentile: str) -> str:
    return f""",
vfit AS (
  SELECT series_id, pos, avg(err) AS mu, (max(err) FILTER (WHERE rn2 = 1) - max(err) FILTER (WHERE rn2 = 2)) / sqrt(2.0) AS u
  FROM (SELECT e.*, dense_rank() OVER (PARTITION BY series_id ORDER BY window_id) AS rn2 FROM errs e WHERE split = 'val')
  GROUP BY series_id, pos
),
vnorm AS (SELECT series_id, sum(u * u) AS uu FROM vfit GROUP BY series_id),
wdist AS (
  SELECT series_id, window_id, split, is_anomaly, is_edge_case, ws, we,
    (sum(pow(err - mu, 2)) - pow(sum(u * (err - mu)), 2) / (1e-6 + any_value(uu))) / 1e-6 AS score
  FROM errs JOIN vfit USING (series_id, pos) JOIN vnorm USING (series_id) GROUP BY ALL
),
wthr AS (
  SELECT series_id, {sql_percentile(percentile)} AS threshold
  FROM (SELECT series_id, list_sort(list(score)) AS s FROM wdist WHERE split = 'threshold' GROUP BY series_id)
),
wflag AS (SELECT wdist.*, threshold, score > threshold AS is_flagged FROM wdist JOIN wthr USING (series_id))"""

WINDOW_SQL = ERROR_SQL + window_part("0.9999")
# In point mode a reply reports the window threshold, at the percentile of that mode.
POINT_AND_WINDOW = window_part("0.95")
