"""Registered queries: all kinds of injected copies, calibration in window mode, detectors through their contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import InjectSpec
from tidemark.operators import inject as inj
from tidemark.plans import detectors, flows, shared as s
from tidemark.plans.catalog import query
from tidemark.plans.queries_scores import BEST_SQL, fitted_errors, inject_sql

NOISY = InjectSpec.with_magnitude(1.0, kinds=inj.KINDS, copies=2)
NOISY_SQL = inject_sql(inj.KINDS, noise=NOISY.noise_scale)

WINDOW_POOL = s.WINDOW_SQL + NOISY_SQL + f""",
hurt AS (
  SELECT i.series_id, i.window_id, i.copy,
    (sum(pow(abs(z - x_hat) - mu, 2)) - pow(sum(u * (abs(z - x_hat) - mu)), 2) / (1e-6 + any_value(uu))) / 1e-6 AS score
  FROM injected i JOIN vfit f ON f.series_id = i.series_id AND f.pos = i.pos JOIN vnorm n ON n.series_id = i.series_id GROUP BY 1, 2, 3
),
pool AS (
  SELECT series_id, score, false AS is_anomaly FROM wdist WHERE split = 'threshold'
  UNION ALL SELECT series_id, score, true FROM hurt
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


@query("M11 J9", s.ERROR_SQL + NOISY_SQL + " SELECT series_id, window_id, copy, kind, pos, round(z, 6) AS z FROM injected")
def noisy_copies(spark, folder):
    """Copies of all four kinds, Gaussian noise by two draws a position among them."""
    ready = fitted_errors(spark, folder).filter(F.col("split") == "threshold")
    out = inj.inject(ready, NOISY, 48, values="z")
    return out.select("series_id", "window_id", "copy", "kind", F.posexplode("z").alias("pos", "z")).withColumn("z", F.round("z", 6))


def _calibrated(spark, folder, method):
    windows = s.prepared(spark, folder)
    params = flows.fit_profile_model(windows, s.DAY, s.WINDOW, s.BY)
    out = flows.calibrate_with_injection(windows, params, NOISY, s.WINDOW, s.BY, 48, method)
    return out.select("series_id", F.round("threshold", 0).alias("threshold"), "threshold_source")


@query(
    "M10 M12 A13",
    WINDOW_POOL
    + """ SELECT series_id, round(CASE WHEN a > n THEN (a + n) / 2 ELSE p99 END, 0) AS threshold,
  CASE WHEN a > n THEN 'midpoint' ELSE 'fallback_percentile_99' END AS threshold_source
FROM (SELECT series_id, min(score) FILTER (WHERE is_anomaly) AS a, max(score) FILTER (WHERE NOT is_anomaly) AS n,
  quantile_cont(score, 0.99) FILTER (WHERE NOT is_anomaly) AS p99 FROM pool GROUP BY 1)""",
)
def window_calibrated_midpoint(spark, folder):
    return _calibrated(spark, folder, "midpoint")


@query(
    "M10 M12 A10 A19 T4",
    WINDOW_POOL + BEST_SQL.format(digits=0, floor="0", name="f1_max", expr="coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"),
)
def window_calibrated_f_score(spark, folder):
    return _calibrated(spark, folder, "f1_max")


@query(
    "M10 M12 A19 T4",
    WINDOW_POOL
    + BEST_SQL.format(digits=0, floor="-1", name="youden", expr="coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0) - 1"),
)
def window_calibrated_youden(spark, folder):
    return _calibrated(spark, folder, "youden")


@query(
    "D4 M7 M8 M15",
    s.POINT_SQL
    + s.window_part("0.9999")
    + """ SELECT 'point' AS detector, series_id, window_id, is_flagged, 48::INTEGER AS min_rows, 2::BIGINT AS n_fit FROM wpoint WHERE split = 'test'
UNION ALL SELECT 'window', series_id, window_id, is_flagged, 48::INTEGER, 2::BIGINT FROM wflag WHERE split = 'test'""",
)
def detector_contract(spark, folder):
    """Two detectors behind one contract: asked whether they are ready, run over the test windows, and described."""
    windows = s.prepared(spark, folder)
    test, parts = windows.filter(F.col("split") == "test"), []
    for name, scorer in (("point", s.POINT), ("window", s.WINDOW)):
        params = flows.fit_profile_model(windows, s.DAY, scorer, s.BY)
        detector = detectors.ProfileDetector(params, scorer, tuple(s.BY), s.DAY.length)
        found = detectors.run(detector, test).select("series_id", "window_id", "is_flagged")
        stats = detector.get_stats().select("series_id", "n_fit")
        parts.append(found.join(stats, "series_id").select(F.lit(name).alias("detector"), *found.columns, F.lit(detector.min_rows).alias("min_rows"), "n_fit"))
    return parts[0].unionByName(parts[1])
