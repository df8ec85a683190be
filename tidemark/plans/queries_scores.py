"""Registered queries: reconstruction, scoring, thresholds, localisation, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import GridSpec, InjectSpec, LocaliseSpec, ScorerSpec, SplitSpec
from tidemark.operators import baseline, calibrate as cal, evaluate as ev, inject as inj, localise as loc, score as sc
from tidemark.operators.grid import bucket, points, regular_windows
from tidemark.operators.quantile import exact_percentiles
from tidemark.plans import flows, shared as s
from tidemark.plans.catalog import query
from tidemark.session import attach, settle
from tidemark.sources.tables import read_table


def fitted_errors(spark, folder, by=s.BY):
    """Prepared windows with the profile model's error vectors."""
    windows = s.prepared(spark, folder)
    base = sc.profile_fit(windows, by, 48)
    return sc.profile_errors(attach(windows, base, by))


def scored(spark, folder, scorer, by=s.BY):
    windows = s.prepared(spark, folder)
    params = flows.fit_profile_model(windows, s.DAY, scorer, by)
    return flows.score_windows(windows, params, scorer, by)


@query("A15 M5", s.ERROR_SQL + " SELECT series_id, pos, round(x_hat, 6) AS x_hat FROM profile")
def seasonal_profile(spark, folder):
    out = sc.profile_fit(s.prepared(spark, folder), s.BY, 48)
    return out.select("series_id", F.posexplode("profile").alias("pos", "x_hat")).withColumn("x_hat", F.round("x_hat", 6))


@query(
    "A15 A16",
    s.SPLIT_SQL
    + """, prof AS (SELECT series_id, pos, avg(value) AS p FROM points JOIN flags USING (series_id, window_id) WHERE NOT is_anomaly GROUP BY 1, 2)
SELECT series_id, window_id, round(avg(pow(value - p, 2)), 4) AS mse FROM points JOIN prof USING (series_id, pos) GROUP BY 1, 2""",
)
def profile_window_mse(spark, folder):
    """Distance of every window to the mean pattern of the normal windows."""
    windows = s.prepared(spark, folder)
    normal = windows.filter(~F.col("is_anomaly"))
    base = sc.profile_fit(normal, s.BY, 48, split=None)
    met = attach(windows, base, s.BY).withColumn("p", sc.unscaled("profile"))
    mse = F.aggregate(F.zip_with("values", "p", lambda a, b: F.pow(a - b, 2)), F.lit(0.0), lambda x, y: x + y) / F.size("values")
    return met.select("series_id", "window_id", F.round(mse, 4).alias("mse"))


@query("X2 A22", s.ERROR_SQL + " SELECT series_id, window_id, split, round(avg(err), 6) AS mean_error, round(max(err), 6) AS max_error FROM errs GROUP BY 1, 2, 3")
def error_summary(spark, folder):
    errors = fitted_errors(spark, folder)
    mean = F.aggregate("err", F.lit(0.0), lambda a, x: a + x) / F.size("err")
    return errors.select("series_id", "window_id", "split", F.round(mean, 6).alias("mean_error"), F.round(F.array_max("err"), 6).alias("max_error"))


@query("A3", s.ERROR_SQL + " SELECT pos, round(avg(err), 6) AS mu FROM errs WHERE split = 'val' GROUP BY pos")
def position_error_mean(spark, folder):
    errors = fitted_errors(spark, folder).filter(F.col("split") == "val")
    return errors.select(F.posexplode("err").alias("pos", "err")).groupBy("pos").agg(F.round(F.avg("err"), 6).alias("mu"))


_ORDER_ERR = s.ORDERS_SQL + """,
prof AS (SELECT series_id, pos, avg(value) AS p FROM points GROUP BY 1, 2),
oerr AS (SELECT series_id, window_id, pos, abs(value - p) AS err FROM points JOIN prof USING (series_id, pos))"""


def order_errors(spark, folder):
    windows = settle(s.order_windows(spark, folder)).df
    base = sc.profile_fit(windows, s.BY, 7, split=None)
    met = attach(windows, base, s.BY).withColumn("z", F.col("values")).withColumn("x_hat", sc.unscaled("profile"))
    return sc.with_errors(met)


@query(
    "A4",
    _ORDER_ERR
    + """ SELECT a.series_id, a.pos AS i, b.pos AS j, round(covar_samp(a.err, b.err) + CASE WHEN a.pos = b.pos THEN 1e-6 ELSE 0 END, 6) AS cov
FROM oerr a JOIN oerr b ON a.series_id = b.series_id AND a.window_id = b.window_id AND a.pos <= b.pos GROUP BY 1, 2, 3""",
)
def position_covariance(spark, folder):
    out = sc.position_covariance(order_errors(spark, folder), s.BY, 7, 1e-6)
    return out.withColumn("cov", F.round("cov", 6))


@query(
    "A4 M7",
    s.VALUES_SQL
    + """, keyed AS (SELECT *, CASE WHEN window_id % 4 = 0 THEN 'quarter' ELSE 'rest' END AS part FROM points)
SELECT a.part, a.pos::INTEGER AS i, b.pos::INTEGER AS j, count(*) AS n_fit, round(covar_samp(a.value, b.value), 3) AS cov
FROM keyed a JOIN keyed b ON a.series_id = b.series_id AND a.window_id = b.window_id AND a.pos <= b.pos GROUP BY ALL""",
)
def keyed_covariance(spark, folder):
    """Covariance of all positions under a key other than the series, one key with three quarters of all windows."""
    windows = regular_windows(s.value_buckets(spark, folder), s.DAY)
    part = F.when(F.col("window_id") % 4 == 0, "quarter").otherwise("rest")
    found = sc.keyed_gram(windows.select(part.alias("part"), F.col("values").alias("err")), ["part"], s.DAY.length)
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(s.DAY.length) for j in range(i, s.DAY.length)])
    cells = found.select("part", "n_fit", F.explode(F.arrays_zip(places.alias("at"), F.col("gram").alias("g"))).alias("c"))
    return cells.select("part", "c.at.i", "c.at.j", "n_fit", F.round(F.col("c.g") / (F.col("n_fit") - 1), 3).alias("cov"))


@query("A5", s.POINT_SQL + " SELECT series_id, round(mu, 8) AS mu_point, round(v, 8) AS var_point FROM pfit")
def pooled_point_params(spark, folder):
    out = sc.point_fit(fitted_errors(spark, folder).filter(F.col("split") == "val"), s.BY, 1e-6)
    return out.select("series_id", F.round("mu_point", 8).alias("mu_point"), F.round("var_point", 8).alias("var_point"))


_TWO = """
WITH b AS (SELECT event_type AS series_id, epoch_us(ts) // 1800000000 AS slot, count(*)::DOUBLE AS n, avg(value) AS v FROM events GROUP BY 1, 2),
m AS (SELECT series_id, avg(n) AS mn, avg(v) AS mv, var_samp(n) + 1e-6 AS a, covar_samp(n, v) AS c, var_samp(v) + 1e-6 AS d FROM b GROUP BY 1)"""


def two_features(spark, folder):
    rows = s.events(spark, folder)
    slot = F.floor(F.unix_seconds("ts") / 1800).cast("long")
    return rows.groupBy(F.col("event_type").alias("series_id"), slot.alias("slot")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("v")
    )


@query("A6", _TWO + " SELECT series_id, round(mn, 6) AS mu_n, round(mv, 6) AS mu_v, round(a, 6) AS cov_n_n, round(c, 6) AS cov_n_v, round(d, 6) AS cov_v_v FROM m")
def feature_covariance(spark, folder):
    out = sc.feature_fit(two_features(spark, folder), s.BY, ["n", "v"], 1e-6)
    return out.select("series_id", *[F.round(c, 6).alias(c) for c in ("mu_n", "mu_v", "cov_n_n", "cov_n_v", "cov_v_v")])


@query(
    "X5 A6",
    _TWO + " SELECT series_id, slot, round((d * pow(n - mn, 2) - 2 * c * (n - mn) * (v - mv) + a * pow(v - mv, 2)) / (a * d - c * c), 6) AS score FROM b JOIN m USING (series_id)",
)
def feature_quadratic_scores(spark, folder):
    rows = settle(two_features(spark, folder)).df
    params = sc.feature_inverse(sc.feature_fit(rows, s.BY, ["n", "v"], 1e-6), s.BY, ["n", "v"])
    met = attach(rows, params, s.BY).withColumn("d", F.zip_with(F.array("n", "v"), "mu", lambda x, m: x - m))
    return met.select("series_id", "slot", F.round(sc.quadratic_form(F.col("d"), F.col("inverse")), 6).alias("score"))


@query(
    "X3 A11 M8",
    s.POINT_SQL + " SELECT series_id, window_id, pos, round(score, 5) AS score FROM ps WHERE split = 'test'",
)
def point_scores(spark, folder):
    out = scored(spark, folder, s.POINT).filter(F.col("split") == "test")
    return out.select("series_id", "window_id", F.posexplode("point_scores").alias("pos", "score")).withColumn("score", F.round("score", 5))


@query(
    "M7 M8 A5 A7 A11 A12 X6 J5 M5",
    s.POINT_SQL + f""" SELECT series_id, window_id, {s.sql_stamp('ws')} AS start_ts, is_anomaly, is_edge_case,
  round(window_score, 5) AS window_score, n_over, is_flagged FROM wpoint WHERE split = 'test'""",
)
def flagged_windows_by_points(spark, folder):
    """Flagship: grid, labels, split, fit, threshold, score and flag per series."""
    out = scored(spark, folder, s.POINT).filter(F.col("split") == "test")
    return out.select(
        "series_id", "window_id", s.stamp("start_ts").alias("start_ts"), "is_anomaly", "is_edge_case",
        F.round("window_score", 5).alias("window_score"), "n_over", "is_flagged",
    )


@query(
    "X4 A4 M7 M8 X6",
    s.WINDOW_SQL + """ SELECT series_id, window_id, split, round(score, 0) AS window_score, round(threshold, 0) AS threshold, is_flagged FROM wflag""",
)
def flagged_windows_by_distance(spark, folder):
    out = scored(spark, folder, s.WINDOW)
    return out.select("series_id", "window_id", "split", F.round("window_score", 0).alias("window_score"), F.round("threshold", 0).alias("threshold"), "is_flagged")


@query(
    "A7 A8",
    s.POINT_SQL
    + """ SELECT series_id, round(quantile_cont(score, 0.95), 5) AS p95, round(quantile_cont(score, 0.9999), 5) AS p9999,
  round(avg(score) + 3 * stddev_pop(score), 5) AS sigma3 FROM ps WHERE split = 'threshold' GROUP BY 1""",
)
def percentile_and_sigma_thresholds(spark, folder):
    errors = settle(fitted_errors(spark, folder).filter(F.col("split").isin("val", "threshold")).select("series_id", "window_id", "split", "err")).df
    params = sc.point_fit(errors.filter(F.col("split") == "val"), s.BY, 1e-6)
    held = sc.point_scores(attach(errors.filter(F.col("split") == "threshold"), params, s.BY))
    pool = settle(held.select("series_id", F.explode("point_scores").alias("score"))).df
    out = None
    for name, spec in (("p95", ScorerSpec(percentile=95.0)), ("p9999", ScorerSpec(percentile=99.99)), ("sigma3", ScorerSpec(threshold_method="sigma"))):
        one = sc.threshold_fit(pool, s.BY, "score", spec).select("series_id", F.round("threshold", 5).alias(name))
        out = one if out is None else out.join(one, "series_id")
    return out


@query(
    "A7 A19",
    """SELECT CASE WHEN f = 0.01 THEN 0 WHEN f = 0.5 THEN 1 WHEN f = 0.95 THEN 2 ELSE 3 END AS cut, round(t, 6) AS threshold FROM (
  SELECT unnest([0.01, 0.5, 0.95, 0.9999]) AS f, unnest(quantile_cont(value, [0.01, 0.5, 0.95, 0.9999])) AS t FROM events)""",
)
def pooled_percentiles(spark, folder):
    """Exact percentiles of one pool of all rows, without collecting the pool."""
    out = exact_percentiles(s.events(spark, folder).select("value"), [], "value", [0.01, 0.5, 0.95, 0.9999])
    return out.select("cut", F.round("threshold", 6).alias("threshold"))


@query(
    "A7",
    """SELECT o_orderpriority AS series_id, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(quantile_cont(o_totalprice, 0.5), 4) AS p50 FROM orders GROUP BY 1""",
)
def grouped_percentiles(spark, folder):
    rows = read_table(spark, folder, "orders").select(F.col("o_orderpriority").alias("series_id"), "o_totalprice")
    out = exact_percentiles(rows, s.BY, "o_totalprice", [0.5, 0.9])
    return out.groupBy("series_id").agg(
        F.round(F.max(F.when(F.col("cut") == 1, F.col("threshold"))), 4).alias("p90"),
        F.round(F.max(F.when(F.col("cut") == 0, F.col("threshold"))), 4).alias("p50"),
    )


_METRIC = """ round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score,
  round(coalesce(1.01 * tp / nullif(1.01 * tp + fp + 0.01 * fn, 0), 0), 6) AS f_beta_score """
_COUNTS = """ count(*) FILTER (WHERE is_flagged AND is_anomaly) AS tp, count(*) FILTER (WHERE is_flagged AND NOT is_anomaly) AS fp,
  count(*) FILTER (WHERE NOT is_flagged AND is_anomaly) AS fn, count(*) FILTER (WHERE NOT is_flagged AND NOT is_anomaly) AS tn """


def rounded_metrics(df):
    return df.select(*[F.round(c, 6).alias(c) if c in ("precision", "recall", "accuracy", "f1_score", "f_beta_score", "train_loss") else F.col(c) for c in df.columns])


@query(
    "A9 A10 P5",
    s.POINT_SQL
    + f", c AS (SELECT series_id, {_COUNTS} FROM wpoint WHERE split = 'test' AND NOT is_edge_case GROUP BY 1) SELECT *, {_METRIC} FROM c",
)
def detection_metrics(spark, folder):
    return rounded_metrics(flows.evaluate(scored(spark, folder, s.POINT), s.BY))


@query(
    "A9 A10",
    """, c AS (SELECT lang, count(*) FILTER (WHERE n_chars > 1500 AND toxic = 1) AS tp, count(*) FILTER (WHERE n_chars > 1500 AND toxic = 0) AS fp,
  count(*) FILTER (WHERE n_chars <= 1500 AND toxic = 1) AS fn, count(*) FILTER (WHERE n_chars <= 1500 AND toxic = 0) AS tn
  FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT *,""".replace(", c AS", "WITH c AS", 1)
    + _METRIC
    + " FROM c",
)
def label_confusion(spark, folder):
    """Confusion counts of a fixed length threshold against the toxic label."""
    rows = read_table(spark, folder, "labels").join(read_table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    counts = ev.confusion(rows, ["lang"], F.col("n_chars") > 1500, F.col("toxic") == 1)
    return rounded_metrics(ev.metrics(counts))


@query(
    "A13 U1",
    s.POINT_SQL
    + """, sep AS (SELECT series_id, max(window_score) FILTER (WHERE NOT is_anomaly) AS max_normal, min(window_score) FILTER (WHERE is_anomaly) AS min_anomaly
  FROM wpoint WHERE split = 'test' GROUP BY 1)
SELECT series_id, round(max_normal, 5) AS max_normal, round(min_anomaly, 5) AS min_anomaly, round(min_anomaly - max_normal, 5) AS gap,
  min_anomaly - max_normal > 0 AS separable FROM sep""",
)
def separability_report(spark, folder):
    out = scored(spark, folder, s.POINT).filter(F.col("split") == "test").withColumnRenamed("window_score", "score")
    return ev.separability(out, s.BY).select("series_id", *[F.round(c, 5).alias(c) for c in ("max_normal", "min_anomaly", "gap")], "separable")


@query(
    "A18",
    s.POINT_SQL
    + """, sp AS (SELECT min(window_score) AS lo, max(window_score) AS hi FROM wpoint)
SELECT CASE WHEN split <> 'test' THEN 'development' WHEN is_anomaly THEN 'anomaly' ELSE 'normal' END AS class,
  least(floor((window_score - lo) / ((hi - lo) / 29)) + 1, 29)::INTEGER AS bin, count(*) AS n FROM wpoint CROSS JOIN sp GROUP BY 1, 2""",
)
def score_histogram(spark, folder):
    out = settle(scored(spark, folder, s.POINT).select("split", "is_anomaly", "window_score")).df
    kind = F.when(F.col("split") != "test", "development").when(F.col("is_anomaly"), "anomaly").otherwise("normal")
    return ev.score_histogram(out.withColumn("class", kind), ["class"], "window_score")


@query(
    "A20",
    s.POINT_SQL
    + " SELECT series_id, window_id, round(window_score / max(window_score) OVER (PARTITION BY series_id), 6) AS normalised FROM wpoint WHERE split = 'test'",
)
def max_normalised_scores(spark, folder):
    out = settle(scored(spark, folder, s.POINT).filter(F.col("split") == "test").select("series_id", "window_id", "window_score")).df
    return ev.max_normalised(out, s.BY, "window_score").select("series_id", "window_id", F.round("normalised", 6).alias("normalised"))


# --- localisation ---------------------------------------------------------------

HOURS = LocaliseSpec()
_SCALES = "(VALUES (1), (2), (3), (6), (12), (24)) h(hours)"
LOCAL_SQL = (
    s.POINT_SQL
    + f""",
lerr AS (
  SELECT e.series_id, e.window_id, e.pos, e.err, e.score, e.value, e.ws,
    sum(err) OVER (PARTITION BY e.series_id, e.window_id ORDER BY e.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM ps e JOIN wpoint w ON e.series_id = w.series_id AND e.window_id = w.window_id WHERE w.is_flagged AND w.split = 'test'
),
sums AS (
  SELECT a.series_id, a.window_id, hours, a.pos, b.upto - (a.upto - a.err) AS total
  FROM lerr a CROSS JOIN {_SCALES} JOIN lerr b ON a.series_id = b.series_id AND a.window_id = b.window_id AND b.pos = a.pos + 2 * hours - 1
),
scales AS (
  SELECT series_id, window_id, hours, arg_max(pos, row(round(total, 9), -pos)) AS t_star, max(total) AS peak_score, avg(total) AS mean_score
  FROM sums GROUP BY 1, 2, 3
),
frames AS (
  SELECT series_id, window_id, pos, count(*) OVER f AS n, avg(err) OVER f AS m, max(err) OVER f AS mx,
    sum(CASE WHEN err > 0.2 THEN 1 ELSE 0 END) OVER f AS above
  FROM lerr WINDOW f AS (PARTITION BY series_id, window_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)
),
spans AS (
  SELECT series_id, window_id, arg_max(pos, row((m > 0 AND mx >= 8 * m)::INTEGER, above, -pos)) AS span_start,
    bool_or(m > 0 AND mx >= 8 * m) AS has_spike
  FROM frames WHERE n = 12 GROUP BY 1, 2
)"""
)


def flagged_tests(spark, folder):
    return scored(spark, folder, s.POINT).filter((F.col("split") == "test") & F.col("is_flagged"))


@query(
    "W6 F4 T4",
    LOCAL_SQL
    + """ SELECT series_id, window_id, hours, t_star, t_star + 2 * hours - 1 AS t_end, round(peak_score, 6) AS peak_score,
  round(mean_score, 6) AS mean_score, round(CASE WHEN mean_score > 0 THEN peak_score / mean_score ELSE 0 END, 6) AS contrast_ratio,
  2 * hours AS window_samples FROM scales""",
)
def scale_peaks(spark, folder):
    out = loc.scale_results(flagged_tests(spark, folder), s.DAY, HOURS)
    return out.select(
        "series_id", "window_id", "hours", "t_star", "t_end", *[F.round(c, 6).alias(c) for c in ("peak_score", "mean_score", "contrast_ratio")], "window_samples"
    )


@query(
    "M9 F5 X7 T4 W6 W7",
    LOCAL_SQL
    + f""" SELECT p.series_id, p.window_id, span_start AS anomaly_start_idx, span_start + 11 AS anomaly_end_idx,
  {s.sql_stamp('ws + 1800 * span_start')} AS anomaly_start, {s.sql_stamp('ws + 1800 * (span_start + 11)')} AS anomaly_end,
  6 AS scale_hours, round(peak_score, 6) AS peak_score, round(peak_score / mean_score, 6) AS contrast_ratio
FROM spans p JOIN scales c ON c.series_id = p.series_id AND c.window_id = p.window_id AND c.hours = 6
JOIN win w ON w.series_id = p.series_id AND w.window_id = p.window_id""",
)
def localised_windows(spark, folder):
    found = loc.localise(flagged_tests(spark, folder), s.DAY, HOURS)
    return found.select(
        "series_id", "window_id", "anomaly_start_idx", "anomaly_end_idx", s.stamp("anomaly_start").alias("anomaly_start"), s.stamp("anomaly_end").alias("anomaly_end"),
        "scale_hours", F.round("peak_score", 6).alias("peak_score"), F.round("contrast_ratio", 6).alias("contrast_ratio"),
    )


_TOP = LOCAL_SQL + """,
top AS (
  SELECT e.*, row_number() OVER (PARTITION BY e.series_id, e.window_id ORDER BY e.score DESC, e.pos) AS rn
  FROM lerr e JOIN spans p ON e.series_id = p.series_id AND e.window_id = p.window_id AND e.pos BETWEEN span_start AND span_start + 11
)"""


@query(
    "T3 U4",
    _TOP + f" SELECT series_id, window_id, pos, {s.sql_stamp('ws + 1800 * pos')} AS ts, round(value, 4) AS value, round(score, 5) AS point_score FROM top WHERE rn <= 3",
)
def top_points_in_span(spark, folder):
    out = loc.top_points(flagged_tests(spark, folder), s.DAY, "point_scores", HOURS)
    return out.select("series_id", "window_id", "pos", s.stamp("ts").alias("ts"), F.round("value", 4).alias("value"), F.round("point_score", 5).alias("point_score"))


@query(
    "P11",
    LOCAL_SQL
    + f""", seen AS (SELECT max(sec) - 604800 AS lo, max(sec) AS hi FROM points)
SELECT p.series_id, p.window_id FROM spans p JOIN win w ON w.series_id = p.series_id AND w.window_id = p.window_id CROSS JOIN seen
WHERE ws + 1800 * (span_start + 11) >= lo AND ws + 1800 * span_start <= hi""",
)
def visible_spans(spark, folder):
    """Flagged spans that meet the last seven days shown."""
    windows = s.prepared(spark, folder)
    params = flows.fit_profile_model(windows, s.DAY, s.POINT, s.BY)
    flagged = flows.score_windows(windows, params, s.POINT, s.BY).filter((F.col("split") == "test") & F.col("is_flagged"))
    shown = windows.agg(F.max("end_ts").alias("hi")).select((F.col("hi") - F.expr("INTERVAL 7 DAYS")).alias("lo"), "hi")
    return ev.in_view(loc.localise(flagged, s.DAY, HOURS), shown).select("series_id", "window_id")


@query(
    "M8 M9",
    LOCAL_SQL
    + s.POINT_AND_WINDOW
    + f""" SELECT w.series_id, w.window_id, w.is_flagged AS is_anomaly, round(w.window_score, 5) AS anomaly_score, round(t.threshold, 3) AS threshold,
  {s.sql_stamp('w.ws')} AS window_start, {s.sql_stamp('w.we')} AS window_end,
  {s.sql_stamp('w.ws + 1800 * span_start')} AS anomaly_start, CASE WHEN span_start IS NULL THEN NULL ELSE 6.0::DOUBLE END AS scale_hours,
  round(peak_score / mean_score, 6) AS contrast_ratio
FROM wpoint w JOIN wthr t ON t.series_id = w.series_id
LEFT JOIN spans p ON p.series_id = w.series_id AND p.window_id = w.window_id
LEFT JOIN scales c ON c.series_id = w.series_id AND c.window_id = w.window_id AND c.hours = 6
WHERE w.split = 'test'""",
)
def score_replies(spark, folder):
    """One reply per window with a nested localisation for flagged ones."""
    windows = s.prepared(spark, folder)
    params = flows.fit_profile_model(windows, s.DAY, s.POINT, s.BY)
    out = flows.detect(windows.filter(F.col("split") == "test"), params, s.DAY, s.POINT, s.BY, HOURS)
    return out.select(
        "series_id", "window_id", "is_anomaly", F.round("anomaly_score", 5).alias("anomaly_score"), F.round("threshold", 3).alias("threshold"),
        s.stamp("window_start").alias("window_start"), s.stamp("window_end").alias("window_end"),
        s.stamp("localization.anomaly_start").alias("anomaly_start"), F.col("localization.scale_hours").alias("scale_hours"),
        F.round("localization.contrast_ratio", 6).alias("contrast_ratio"),
    )


@query(
    "M8 T2",
    s.grid_sql("SELECT CAST(o_custkey AS VARCHAR) AS series_id, epoch_us(o_orderdate) // 86400000000 AS slot, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2", 86400, 180)
    + """, n AS (SELECT series_id, count(*) AS n_windows FROM win GROUP BY 1)
SELECT series_id, n_windows FROM n WHERE n_windows < 12""",
)
def unscored_series(spark, folder):
    """Series too short for the split 9/2/1 have no complete model: they are reported, not lost."""
    grid, split = GridSpec(step_seconds=86400, length=180), SplitSpec(train=9, val=2, threshold=1)
    key = F.col("o_custkey").cast("string").alias("customer")
    buckets = bucket(read_table(spark, folder, "orders").select(key, "o_orderdate"), "customer", "o_orderdate", 86400)
    return flows.unscored_of(buckets, grid, split, s.POINT)


# --- calibration and injection ----------------------------------------------------

MILD = InjectSpec.with_magnitude(1.0, kinds=("point", "level_shift", "temporal"), copies=2)


def _hash(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def inject_sql(kinds, noise: float = 0.0) -> str:
    """Injected copies of magnitude 1 of the threshold windows, two a window."""
    wave = f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {_hash('p.k', "'u'", 'p.pos::VARCHAR')} / 4294967296.0::DOUBLE)) * cos(2 * 3.141592653589793::DOUBLE * ({_hash('p.k', "'v'", 'p.pos::VARCHAR')} / 4294967296.0::DOUBLE))"
    return f""",
copied AS (
  SELECT z.series_id, z.window_id, z.pos, z.z, z.x_hat, c.copy, '42:' || z.series_id || ':' || z.window_id || ':' || c.copy AS k
  FROM errs z CROSS JOIN (VALUES (0), (1)) c(copy) WHERE z.split = 'threshold'
),
wstat AS (
  SELECT series_id, window_id, copy, any_value(k) AS k, stddev_pop(z) AS sd,
    {list(kinds)}[({_hash("any_value(k)", "'kind'")} % {len(kinds)}) + 1] AS kind,
    {_hash("any_value(k)", "'start'")} % (49 - 14) AS beg,
    CASE WHEN {_hash("any_value(k)", "'sign'")} % 2 = 0 THEN -1 ELSE 1 END AS sgn
  FROM copied GROUP BY 1, 2, 3
),
placed AS (
  SELECT c.*, w.sd, w.kind, w.beg, w.sgn,
    row_number() OVER (PARTITION BY c.series_id, c.window_id, c.copy ORDER BY {_hash("c.k", "'place'", "c.pos::VARCHAR")}, c.pos) AS pr,
    CASE WHEN {_hash("c.k", "'sign'", "c.pos::VARCHAR")} % 2 = 0 THEN -1 ELSE 1 END AS psgn
  FROM copied c JOIN wstat w USING (series_id, window_id, copy)
),
injected AS (
  SELECT p.series_id, p.window_id, p.copy, p.pos, p.kind, p.x_hat,
    CASE p.kind WHEN 'point' THEN p.z + CASE WHEN p.pr <= 5 THEN p.psgn * 1.0 * p.sd ELSE 0 END
      WHEN 'level_shift' THEN p.z + CASE WHEN p.pos >= p.beg AND p.pos < p.beg + 14 THEN p.sgn * 1.0 * p.sd ELSE 0 END
      WHEN 'noise' THEN p.z + CASE WHEN p.pos >= p.beg AND p.pos < p.beg + 14 THEN {wave} * {noise}::DOUBLE * p.sd ELSE 0 END
      ELSE r.z END AS z
  FROM placed p JOIN copied r ON r.series_id = p.series_id AND r.window_id = p.window_id AND r.copy = p.copy AND r.pos = (p.pos + 48 - 12) % 48
)"""


INJECT_SQL = inject_sql(MILD.kinds)


@query(
    "M11 J9 F7 A17",
    s.ERROR_SQL + INJECT_SQL + " SELECT series_id, window_id, copy, kind, pos, round(z, 6) AS z FROM injected",
)
def injected_copies(spark, folder):
    ready = fitted_errors(spark, folder).filter(F.col("split") == "threshold")
    out = inj.inject(ready, MILD, 48, values="z")
    return out.select("series_id", "window_id", "copy", "kind", F.posexplode("z").alias("pos", "z")).withColumn("z", F.round("z", 6))


@query(
    "M11",
    s.EVENTS_SQL
    + f""" SELECT series_id, window_id, pos, value FROM (
  SELECT p.series_id, p.window_id, p.pos, r.value FROM points p JOIN points r
  ON r.series_id = p.series_id AND r.window_id = p.window_id AND r.pos = (p.pos + 48 - 12) % 48)""",
)
def circular_shift(spark, folder):
    """F7 as an injection of the temporal kind only."""
    out = inj.inject(s.event_windows(spark, folder), InjectSpec(kinds=("temporal",)), 48)
    return out.select("series_id", "window_id", F.posexplode("values").alias("pos", "value"))


CAL_SQL = s.POINT_SQL + INJECT_SQL + f""",
pool AS (
  SELECT series_id, window_score AS score, false AS is_anomaly FROM wpoint WHERE split = 'threshold'
  UNION ALL
  SELECT series_id, max(pow(abs(z - x_hat) - mu, 2) / v), true FROM injected JOIN pfit USING (series_id) GROUP BY series_id, window_id, copy
),
cands AS (
  SELECT series_id, cut, {s.sql_percentile("(1 + 0.5::DOUBLE * cut) / 100")} AS t
  FROM (SELECT series_id, list_sort(list(score)) AS s FROM pool GROUP BY 1) CROSS JOIN (SELECT unnest(range(0, 198)) AS cut)
),
counts AS (
  SELECT c.series_id, cut, t, count(*) FILTER (WHERE score > t AND is_anomaly) AS tp, count(*) FILTER (WHERE score > t AND NOT is_anomaly) AS fp,
    count(*) FILTER (WHERE NOT score > t AND is_anomaly) AS fn, count(*) FILTER (WHERE NOT score > t AND NOT is_anomaly) AS tn
  FROM cands c JOIN pool p ON p.series_id = c.series_id GROUP BY 1, 2, 3
)"""


def calibration_pool(spark, folder):
    windows = s.prepared(spark, folder)
    params = flows.fit_profile_model(windows, s.DAY, s.POINT, s.BY)
    return windows, params


@query(
    "J7 A19 U1",
    """WITH pool AS (SELECT l_extendedprice::DOUBLE AS score, l_returnflag = 'R' AS is_anomaly FROM lineitem),
span AS (SELECT list_sort(list(score)) AS s, min(score) AS lo, max(score) AS hi FROM pool),
cands AS (
  SELECT 'percentile' AS kind, c::INTEGER AS cut, """
    + s.sql_percentile("(1 + 0.5::DOUBLE * c) / 100")
    + """ AS t FROM span CROSS JOIN (SELECT unnest(range(0, 198)) AS c)
  UNION ALL SELECT 'even', c::INTEGER, CASE WHEN c = 499 THEN hi ELSE c * ((hi - lo) / 499) + lo END FROM span CROSS JOIN (SELECT unnest(range(0, 500)) AS c)
)
SELECT kind, cut, round(t, 6) AS threshold, count(*) FILTER (score > t AND is_anomaly) AS tp, count(*) FILTER (score > t AND NOT is_anomaly) AS fp,
  count(*) FILTER (NOT score > t AND is_anomaly) AS fn, count(*) FILTER (NOT score > t AND NOT is_anomaly) AS tn
FROM cands CROSS JOIN pool GROUP BY kind, cut, t""",
)
def pooled_score_curve(spark, folder):
    """Both candidate lists on one pool of all rows: read once, equal scores collapsed, spread over range partitions."""
    pool = s.read_table(spark, folder, "lineitem").select(F.col("l_extendedprice").cast("double").alias("score"), (F.col("l_returnflag") == "R").alias("is_anomaly"))
    each = cal.distinct_scores(pool, [], bounded=False)
    n = len(cal.CANDIDATE_FRACTIONS)
    even = cal.even_candidates(each.withColumnRenamed("value", "score"), [])
    # One running sum for both lists: the even ones are numbered after the percentiles.
    listed = cal.distinct_candidates(each, []).unionByName(even.withColumn("cut", F.col("cut") + n))
    out = cal.distinct_curve(each, listed, [], bounded=False).withColumn("threshold", F.round("threshold", 6))
    kind = F.when(F.col("cut") < n, "percentile").otherwise("even")
    return out.select(kind.alias("kind"), F.when(F.col("cut") < n, F.col("cut")).otherwise(F.col("cut") - n).alias("cut"), *out.columns[1:])


@query(
    "A7 A19",
    """SELECT unnest([0, 1, 2, 3])::INTEGER AS cut, unnest([0.05, 0.5, 0.95, 0.999])::DOUBLE AS fraction,
  round(unnest(quantile_cont(l_extendedprice::DOUBLE * (1 + l_discount::DOUBLE), [0.05, 0.5, 0.95, 0.999])), 4) AS threshold FROM lineitem""",
)
def percentiles_in_wide_brackets(spark, folder):
    """A sketch so coarse that its brackets hold thousands of distinct values: they are ranked over range partitions."""
    rows = s.read_table(spark, folder, "lineitem").select((F.col("l_extendedprice").cast("double") * (1 + F.col("l_discount").cast("double"))).alias("v"))
    out = exact_percentiles(rows, [], "v", [0.05, 0.5, 0.95, 0.999], accuracy=40, most=1000)
    return out.select(F.col("cut").cast("int").alias("cut"), "fraction", F.round("threshold", 4).alias("threshold"))


@query("J7 U1", CAL_SQL + " SELECT series_id, cut, round(t, 4) AS threshold, tp, fp, fn, tn FROM counts")
def candidate_thresholds(spark, folder):
    windows, params = calibration_pool(spark, folder)
    normal = attach(windows.filter(F.col("split") == "threshold"), params, s.BY)
    normal = normal.withColumn("z", sc.scaled("values")).withColumn("x_hat", F.col("profile"))

    def best(rows):
        return sc.point_scores(sc.with_errors(rows)).select("series_id", F.col("window_score").alias("score"))

    pool = settle(cal.labelled_union(best(normal), best(inj.inject(normal, MILD, 48, values="z")))).df
    out = cal.score_curve(pool, cal.score_candidates(pool, s.BY), s.BY)
    return out.withColumn("threshold", F.round("threshold", 4))


def _calibrated(method):
    def run(spark, folder):
        windows, params = calibration_pool(spark, folder)
        out = flows.calibrate_with_injection(windows, params, MILD, s.POINT, s.BY, 48, method)
        return out.select("series_id", F.round("threshold", 4).alias("threshold"), "threshold_source")

    return run


@query(
    "M10 M12 A13",
    CAL_SQL
    + """ SELECT series_id, round(CASE WHEN a > n THEN (a + n) / 2 ELSE p99 END, 4) AS threshold,
  CASE WHEN a > n THEN 'midpoint' ELSE 'fallback_percentile_99' END AS threshold_source
FROM (SELECT series_id, min(score) FILTER (WHERE is_anomaly) AS a, max(score) FILTER (WHERE NOT is_anomaly) AS n,
  quantile_cont(score, 0.99) FILTER (WHERE NOT is_anomaly) AS p99 FROM pool GROUP BY 1)""",
)
def calibrated_midpoint(spark, folder):
    return _calibrated("midpoint")(spark, folder)


BEST_SQL = """ SELECT series_id, round(CASE WHEN max(o) > {floor} THEN arg_max(t, row(round(o, 12), -cut)) ELSE any_value(med) END, {digits}) AS threshold,
  CASE WHEN max(o) > {floor} THEN '{name}' ELSE 'fallback_median' END AS threshold_source
FROM (SELECT series_id, cut, t, {expr} AS o FROM counts) JOIN (SELECT series_id, quantile_cont(score, 0.5) AS med FROM pool GROUP BY 1) USING (series_id) GROUP BY 1"""


@query("M10 M12 A10 A19 T4", CAL_SQL + BEST_SQL.format(digits=4, floor="0", name="f1_max", expr="coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"))
def calibrated_f_score(spark, folder):
    return _calibrated("f1_max")(spark, folder)


@query(
    "M10 M12 A19 T4",
    CAL_SQL + BEST_SQL.format(digits=4, floor="-1", name="youden", expr="coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0) - 1"),
)
def calibrated_youden(spark, folder):
    return _calibrated("youden")(spark, folder)
