"""Registered queries: LSTM reconstruction and training, sweeps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.config import ModelSpec, ScorerSpec, TrainSpec
from tidemark.operators import calibrate as cal, evaluate as ev, lstm, score as sc, sweep
from tidemark.operators.grid import regular_windows
from tidemark.operators.quantile import exact_percentiles
from tidemark.plans import flows, runs, shared as s
from tidemark.plans.catalog import query
from tidemark.plans.queries_scores import rounded_metrics
from tidemark.session import attach, fresh_folder, settle
from tidemark.sources import versions
from tidemark.sources.artifacts import load, save, scorer_stats

# Hidden size 1: input, recurrent, two biases for the four gates of encoder and decoder, then the output.
UNIT = ModelSpec(hidden=1, length=48)
UNIT_THETA = [
    0.6, -0.3, 0.9, 0.4, 0.2, 0.1, -0.5, 0.3, 0.05, 0.4, -0.1, 0.2, 0.1, 0.5, 0.0, -0.2,
    -0.4, 0.7, 0.8, 0.5, 0.3, -0.2, 0.6, 0.1, 0.1, 0.3, 0.2, -0.1, 0.0, 0.2, 0.1, 0.3,
    1.7, -0.2,
]


def _cell(x: str, h: str, c: str, at: int) -> tuple[str, str]:
    t = UNIT_THETA[at : at + 16]

    def gate(k):
        return f"({t[k]}::DOUBLE * {x} + {t[4 + k]}::DOUBLE * {h} + {t[8 + k] + t[12 + k]}::DOUBLE)"

    def sigmoid(v):
        return f"(1.0::DOUBLE / (1.0 + exp(-{v})))"

    cell = f"({sigmoid(gate(1))} * {c} + {sigmoid(gate(0))} * tanh({gate(2)}))"
    return cell, f"{sigmoid(gate(3))}"


_EC, _EO = _cell("p.z", "e.h", "e.c", 0)
_E0C, _E0O = _cell("p.z", "0.0::DOUBLE", "0.0::DOUBLE", 0)
_OUT = f"({UNIT_THETA[32]}::DOUBLE * h + {UNIT_THETA[33]}::DOUBLE)"

_ENC = s.ERROR_SQL + f""",
enc AS (
  SELECT series_id, window_id, pos, o * tanh(c) AS h, c FROM (SELECT p.series_id, p.window_id, p.pos, {_E0C} AS c, {_E0O} AS o FROM zp p WHERE pos = 0)
  UNION ALL
  SELECT series_id, window_id, pos, o * tanh(c) AS h, c FROM (
    SELECT p.series_id, p.window_id, p.pos, {_EC} AS c, {_EO} AS o
    FROM enc e JOIN zp p ON p.series_id = e.series_id AND p.window_id = e.window_id AND p.pos = e.pos + 1)
)"""


def _decoder(name: str, x_next: str) -> str:
    c0, o0 = _cell("p.z", "e.h", "e.c", 16)
    c1, o1 = _cell(x_next, "d.h", "d.c", 16)
    return f""",
{name} AS (
  SELECT series_id, window_id, 0 AS k, o * tanh(c) AS h, c FROM (
    SELECT p.series_id, p.window_id, {c0} AS c, {o0} AS o
    FROM enc e JOIN zp p ON p.series_id = e.series_id AND p.window_id = e.window_id AND p.pos = 47 WHERE e.pos = 47)
  UNION ALL
  SELECT series_id, window_id, k, o * tanh(c) AS h, c FROM (
    SELECT d.series_id, d.window_id, d.k + 1 AS k, {c1} AS c, {o1} AS o
    FROM {name} d JOIN zp p ON p.series_id = d.series_id AND p.window_id = d.window_id AND p.pos = 46 - d.k)
)"""


def scaled_windows(spark, folder):
    windows = s.prepared(spark, folder)
    out = attach(windows, sc.scaler_fit(windows, s.BY), s.BY).withColumn("z", sc.scaled("values"))
    return out.select("series_id", "window_id", "split", "is_anomaly", "is_edge_case", "values", "z")


@query("M1 X13 D3", _ENC + _decoder("dec", "p.z") + f" SELECT series_id, window_id, (47 - k)::INTEGER AS pos, round({_OUT}, 6) AS x_hat FROM dec")
def lstm_reconstruction(spark, folder):
    out = lstm.reconstruct(scaled_windows(spark, folder), lstm.model_table(spark, UNIT, np.array(UNIT_THETA)), [])
    return out.select("series_id", "window_id", F.posexplode("x_hat").alias("pos", "x_hat")).withColumn("x_hat", F.round("x_hat", 6))


@query("M2", _ENC + " SELECT series_id, window_id, round(h, 6) AS h, round(c, 6) AS c FROM enc WHERE pos = 47")
def lstm_encoding(spark, folder):
    out = lstm.reconstruct(scaled_windows(spark, folder), lstm.model_table(spark, UNIT, np.array(UNIT_THETA)), [], "encode")
    return out.select("series_id", "window_id", F.round(F.get("h", F.lit(0)), 6).alias("h"), F.round(F.get("c", F.lit(0)), 6).alias("c"))


@query(
    "M3 X13",
    _ENC + _decoder("gen", _OUT.replace("* h", "* d.h")) + f" SELECT series_id, window_id, (47 - k)::INTEGER AS pos, round({_OUT}, 6) AS x_hat FROM gen",
)
def lstm_generation(spark, folder):
    out = lstm.reconstruct(scaled_windows(spark, folder), lstm.model_table(spark, UNIT, np.array(UNIT_THETA)), [], "generate")
    return out.select("series_id", "window_id", F.posexplode("x_hat").alias("pos", "x_hat")).withColumn("x_hat", F.round("x_hat", 6))


# One model per series, two layers of hidden size 4, on weeks of 336 half hours. Weight i of a series is
# 0.6 sin(k i), where k comes from its name.
DEEP = ModelSpec(hidden=4, layers=2)
_HALF = (DEEP.parameter_count - 5) // 2


def _sql_layer(at: str, width: int, x: str, h: str) -> str:
    """Gate sums of a layer whose weights begin at ``at`` (0-based)."""
    recurrent, bias = f"{at} + {16 * width}", f"{at} + {16 * (width + 4)}"
    return f"""list_transform(range(0, 16), lambda r: list_dot_product(th[{at} + {width} * r + 1:{at} + {width} * r + {width}], {x})
    + list_dot_product(th[{recurrent} + 4 * r + 1:{recurrent} + 4 * r + 4], {h}) + (th[{bias} + r + 1] + th[{bias} + 16 + r + 1]))"""


def _sql_cell(a: str, c: str) -> str:
    return f"list_transform(range(1, 5), lambda i: {c}[i] / (1.0 + exp(-{a}[4 + i])) + tanh({a}[8 + i]) / (1.0 + exp(-{a}[i])))"


def _sql_hidden(a: str, c: str) -> str:
    return f"list_transform(range(1, 5), lambda i: tanh({c}[i]) / (1.0 + exp(-{a}[12 + i])))"


_DEEP_SQL = s.grid_sql(s.VALUE_BUCKETS, 1800, 336, 288) + f""",
scaler AS (SELECT series_id, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale FROM points GROUP BY 1),
zw AS (SELECT series_id, window_id, list((value - mean) / scale ORDER BY pos) AS z FROM points JOIN scaler USING (series_id) GROUP BY 1, 2),
model AS (SELECT DISTINCT series_id, list_transform(range(1, {DEEP.parameter_count + 1}), lambda i: 0.6 * sin((i * (ascii(series_id) + length(series_id)))::DOUBLE)) AS th FROM zw),
st AS (
  SELECT series_id, window_id, -1 AS t, [0.0, 0, 0, 0]::DOUBLE[] AS h0, [0.0, 0, 0, 0]::DOUBLE[] AS c0, [0.0, 0, 0, 0]::DOUBLE[] AS h1, [0.0, 0, 0, 0]::DOUBLE[] AS c1 FROM zw
  UNION ALL
  SELECT series_id, window_id, t, h0, c0, {_sql_hidden('a', 'c1')} AS h1, c1 FROM (
    SELECT * EXCLUDE (c1), {_sql_cell('a', 'c1')} AS c1 FROM (
      SELECT * EXCLUDE (a), {_sql_layer('b + 112', 4, 'h0', 'h1')} AS a FROM (
        SELECT * EXCLUDE (h0), {_sql_hidden('a', 'c0')} AS h0 FROM (
          SELECT * EXCLUDE (c0), {_sql_cell('a', 'c0')} AS c0 FROM (
            SELECT *, {_sql_layer('b', 1, 'x', 'h0')} AS a FROM (
              SELECT st.* EXCLUDE (t), st.t + 1 AS t, CASE WHEN st.t + 1 < 336 THEN 0 ELSE {_HALF} END AS b, th,
                [CASE WHEN st.t + 1 < 336 THEN z[st.t + 2] ELSE z[671 - st.t] END] AS x
              FROM st JOIN zw USING (series_id, window_id) JOIN model USING (series_id) WHERE st.t < 671))))))
)
SELECT series_id, window_id, (671 - t)::INTEGER AS pos, round(list_dot_product(th[{2 * _HALF + 1}:{2 * _HALF + 4}], h1) + th[{2 * _HALF + 5}], 6) AS x_hat
FROM st JOIN model USING (series_id) WHERE t >= 336"""


@query("M1 X13 D3", _DEEP_SQL)
def weekly_reconstruction_per_series(spark, folder):
    """A model of its own for every series; models travel, windows stay."""
    windows = regular_windows(s.value_buckets(spark, folder), s.WEEK).withColumn("split", F.lit("train"))
    scaled = attach(windows, sc.scaler_fit(windows, s.BY), s.BY).withColumn("z", sc.scaled("values"))
    k = (F.ascii("series_id") + F.length("series_id")).cast("long")
    theta = F.transform(F.sequence(F.lit(1), F.lit(DEEP.parameter_count)), lambda i: 0.6 * F.sin((i * k).cast("double")))
    models = windows.select("series_id").distinct().select(
        "series_id", F.lit(1).alias("input_dim"), F.lit(DEEP.hidden).alias("hidden"), F.lit(DEEP.layers).alias("layers"), F.lit(0.0).alias("dropout"), theta.alias("theta")
    )
    out = lstm.reconstruct(scaled.select("series_id", "window_id", "z"), models, s.BY)
    return out.select("series_id", "window_id", F.posexplode("x_hat").alias("pos", "x_hat")).withColumn("x_hat", F.round("x_hat", 6))


@query(
    "S10 A5 A7",
    s.POINT_SQL
    + """ SELECT series_id, round(mean, 6) AS mean, round(scale, 6) AS scale, round(mu, 8) AS mu_point, round(v, 8) AS var_point, round(tau, 5) AS point_threshold
FROM scaler JOIN pfit USING (series_id) JOIN thr USING (series_id)""",
)
def saved_parameters(spark, folder):
    """Fitted parameters written as a table and loaded back."""
    windows = s.prepared(spark, folder)
    params = flows.fit_profile_model(windows, s.DAY, s.POINT, s.BY)
    store = fresh_folder(spark, "artifacts")
    save(params, store, "scorer", "profile")
    back = load(spark, store, "scorer", "profile")
    return back.select(
        "series_id", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"), F.round("mu_point", 8).alias("mu_point"),
        F.round("var_point", 8).alias("var_point"), F.round("point_threshold", 5).alias("point_threshold"),
    )


@query(
    "S10 M8",
    s.POINT_SQL
    + f""",
thr90 AS (SELECT series_id, {s.sql_percentile("0.9")} AS tau FROM (SELECT series_id, list_sort(list(score)) AS s FROM ps WHERE split = 'threshold' GROUP BY series_id)),
w90 AS (SELECT series_id, window_id, count(*) FILTER (WHERE score > tau) AS n FROM ps JOIN thr90 USING (series_id) GROUP BY 1, 2)
SELECT series_id, window_id, split, is_flagged, n_over, n AS newest_n_over, 2::INTEGER AS newest FROM wpoint JOIN w90 USING (series_id, window_id)""",
)
def older_version_scores(spark, folder):
    """Two versions of one model set are published; windows are scored with the older one, next to the newest."""
    labelled = s.labelled(spark, folder)
    store = fresh_folder(spark, "versions")
    for percentile in (95.0, 90.0):
        runs.train_profile_and_save(labelled, store, "values", s.DAY, s.SPLITS, ScorerSpec(percentile=percentile), s.BY)
    keys = ["series_id", "window_id"]
    older = runs.load_and_score(labelled, store, "values", s.BY, version=1).select(*keys, "split", "is_flagged", "n_over")
    newer = runs.load_and_score(labelled, store, "values", s.BY).select(*keys, F.col("n_over").alias("newest_n_over"))
    return older.join(newer, keys).withColumn("newest", F.lit(versions.newest(spark, store, "values")))


@query(
    "M15",
    s.WINDOW_SQL
    + """ SELECT f.series_id, round(min(mu), 6) AS mu_min, round(max(mu), 6) AS mu_max, count(*) AS window_length, 1 AS rank, 2 AS n_fit,
  round(log10((any_value(uu) + 1e-6) / 1e-6), 4) AS log_condition, round(any_value(threshold), 0) AS threshold
FROM vfit f JOIN vnorm n ON n.series_id = f.series_id JOIN wthr w ON w.series_id = f.series_id GROUP BY 1""",
)
def fitted_scorer_stats(spark, folder):
    """Ranges, shape, rank and condition number of the fitted window covariance."""
    windows = s.prepared(spark, folder)
    params = flows.fit_profile_model(windows, s.DAY, s.WINDOW, s.BY)
    out = scorer_stats(params, s.BY, s.WINDOW.ridge)
    return out.select(
        "series_id", F.round("mu_min", 6).alias("mu_min"), F.round("mu_max", 6).alias("mu_max"), "window_length", "rank", "n_fit",
        F.round(F.log10("condition_number"), 4).alias("log_condition"), F.round("threshold", 0).alias("threshold"),
    )


# --- sweeps -----------------------------------------------------------------------

def _eliminations(n: int) -> str:
    """Scores under the covariance of the fit windows: one rank-one update of the ridge inverse per window.

    ``m0`` has all inner products under the inverse of the ridge alone; step k takes out direction k.
    """
    steps = [
        f"""m{k} AS MATERIALIZED (
  SELECT a.trial_id, a.series_id, a.x, a.y, a.v - coalesce(b.v * c.v / (1 + d.v), 0) AS v FROM m{k - 1} a
  LEFT JOIN m{k - 1} b ON b.trial_id = a.trial_id AND b.series_id = a.series_id AND b.x = a.x AND b.y = {k}
  LEFT JOIN m{k - 1} c ON c.trial_id = a.trial_id AND c.series_id = a.series_id
    AND c.x = (CASE WHEN a.y < 1000 THEN a.y ELSE a.x END) AND c.y = {k}
  LEFT JOIN m{k - 1} d ON d.trial_id = a.trial_id AND d.series_id = a.series_id AND d.x = {k} AND d.y = {k}
),"""
        for k in range(1, n + 1)
    ]
    return "\n".join(steps)


SWEEP_SQL = (
    s.SPLIT_SQL
    + """,
trials AS (
  SELECT row_number() OVER (ORDER BY tr, va) - 1 AS trial_id, tr, va, 14 - tr - va AS th
  FROM (SELECT unnest(range(4, 12)) AS tr) CROSS JOIN (SELECT unnest(range(2, 10)) AS va) WHERE 14 - tr - va >= 1
),
fanned AS (
  SELECT t.trial_id, r.series_id, r.window_id, r.is_anomaly, r.is_edge_case,
    CASE WHEN r.is_anomaly OR rn > 14 THEN 'test' WHEN rn <= tr THEN 'train' WHEN rn <= tr + va THEN 'val' ELSE 'threshold' END AS split
  FROM ranked r CROSS JOIN trials t
),
tp AS (SELECT f.*, p.pos, p.value FROM fanned f JOIN points p USING (series_id, window_id)),
tsc AS (SELECT trial_id, series_id, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale FROM tp WHERE split = 'train' GROUP BY 1, 2),
tz AS (SELECT tp.*, (value - mean) / scale AS z FROM tp JOIN tsc USING (trial_id, series_id)),
tprof AS (SELECT trial_id, series_id, pos, avg(z) AS x_hat FROM tz WHERE split = 'train' GROUP BY 1, 2, 3),
terr AS MATERIALIZED (SELECT tz.*, abs(z - x_hat) AS err FROM tz JOIN tprof USING (trial_id, series_id, pos)),
tmu AS (SELECT trial_id, series_id, pos, avg(err) AS mu FROM terr WHERE split = 'val' GROUP BY 1, 2, 3),
tn AS (SELECT trial_id, series_id, count(DISTINCT window_id) AS n FROM terr WHERE split = 'val' GROUP BY 1, 2),
td AS MATERIALIZED (
  SELECT trial_id, series_id, window_id, split, is_anomaly, is_edge_case, list(err - mu ORDER BY pos) AS d
  FROM terr JOIN tmu USING (trial_id, series_id, pos) WHERE split <> 'train' GROUP BY ALL
),
tu AS (
  SELECT trial_id, series_id, row_number() OVER (PARTITION BY trial_id, series_id ORDER BY window_id) AS k,
    list_transform(d, lambda x: x / sqrt(n - 1)) AS u
  FROM td JOIN tn USING (trial_id, series_id) WHERE split = 'val'
),
tv AS MATERIALIZED (SELECT trial_id, series_id, k AS x, u AS vec FROM tu UNION ALL
       SELECT trial_id, series_id, 1000 + window_id, d FROM td WHERE split <> 'val'),
m0 AS MATERIALIZED (
  SELECT a.trial_id, a.series_id, a.x, b.x AS y, list_dot_product(a.vec, b.vec) / 1e-6 AS v
  FROM tv a JOIN tv b ON a.trial_id = b.trial_id AND a.series_id = b.series_id AND (b.x < 1000 OR b.x = a.x)
),
"""
    + _eliminations(9)
    + """
tscore AS MATERIALIZED (SELECT trial_id, series_id, x - 1000 AS window_id, v AS score FROM m9 WHERE x >= 1000 AND x = y),
tthr AS (
  SELECT trial_id, series_id, """
    + s.sql_percentile("0.95")
    + """ AS tau
  FROM (SELECT trial_id, series_id, list_sort(list(score)) AS s FROM tscore JOIN td USING (trial_id, series_id, window_id) WHERE split = 'threshold' GROUP BY 1, 2)
),
tw AS (
  SELECT trial_id, series_id, window_id, is_anomaly, is_edge_case, score > tau AS is_flagged
  FROM tscore JOIN td USING (trial_id, series_id, window_id) JOIN tthr USING (trial_id, series_id) WHERE split = 'test'
),
tc AS (
  SELECT trial_id, count(*) FILTER (WHERE is_flagged AND is_anomaly) AS tp, count(*) FILTER (WHERE is_flagged AND NOT is_anomaly) AS fp,
    count(*) FILTER (WHERE NOT is_flagged AND is_anomaly) AS fn, count(*) FILTER (WHERE NOT is_flagged AND NOT is_anomaly) AS tn
  FROM tw WHERE NOT is_edge_case GROUP BY 1
),
tres AS (
  SELECT trial_id, tr AS train, va AS val, th AS threshold, tp, fp, fn, tn,
    coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score
  FROM tc JOIN trials USING (trial_id)
)"""
)


def split_results(spark, folder):
    windows = s.labelled(spark, folder)
    trials = sweep.split_trials(spark)
    return sweep.run_sweep(windows, trials, s.DAY, ScorerSpec(mode="window")), trials


@query(
    "M13 M14 A9 A10",
    SWEEP_SQL
    + " SELECT trial_id, train, val, threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score FROM tres",
)
def split_sweep(spark, folder):
    out, _ = split_results(spark, folder)
    return rounded_metrics(out.select("trial_id", "train", "val", "threshold", "tp", "fp", "fn", "tn", "precision", "recall", "accuracy", "f1_score"))


@query(
    "T5 S9 M14",
    SWEEP_SQL + " SELECT trial_id, train, val, threshold, round(f1_score, 6) AS f1_score FROM tres ORDER BY round(f1_score, 9) DESC, trial_id LIMIT 20",
)
def sweep_leaderboard(spark, folder):
    out, _ = split_results(spark, folder)
    top = ev.leaderboard(out.withColumn("rounded", F.round("f1_score", 9)), "rounded")
    return top.select("trial_id", "train", "val", "threshold", F.round("f1_score", 6).alias("f1_score"))


@query(
    "M14 S9 S10 T4",
    SWEEP_SQL
    + """ SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score
FROM tres ORDER BY round(f1_score, 9) DESC, trial_id LIMIT 1""",
)
def best_trial_refit(spark, folder):
    """The best split of the sweep, trained again on its own, saved as a version and evaluated from the saved state."""
    windows = settle(s.labelled(spark, folder)).df
    results = sweep.run_sweep(windows, sweep.split_trials(spark), s.DAY, ScorerSpec(mode="window"))
    store = fresh_folder(spark, "versions")
    runs.refit_best(results.withColumn("rounded", F.round("f1_score", 9)), "rounded", windows, store, "best", s.DAY, TrainSpec(), s.BY, "window", "profile")
    out = flows.evaluate(runs.load_and_score(windows, store, "best", s.BY), [])
    return rounded_metrics(out.select("tp", "fp", "fn", "tn", "precision", "recall", "accuracy", "f1_score"))


@query(
    "S9 T4 X12",
    SWEEP_SQL
    + """ SELECT 36 AS configs_tested, count(*) AS completed_runs, round(100.0 * count(*) / 36, 1)::DOUBLE AS progress_pct, 'accuracy' AS sort_by, 0.1::DOUBLE AS beta,
  arg_max(trial_id, row(round(accuracy, 9), -trial_id)) AS best_trial FROM tres""",
)
def sweep_report(spark, folder):
    out, trials = split_results(spark, folder)
    rounded = settle(out.withColumn("accuracy", F.round("accuracy", 9))).df
    report = sweep.sweep_summary(rounded, trials, "accuracy")
    return report.select("configs_tested", "completed_runs", "progress_pct", "sort_by", "beta", F.col("best_config.trial_id").alias("best_trial"))


@query(
    "J6 M13",
    s.EVENTS_SQL
    + """, axes AS (SELECT h, l, d, r, p FROM (VALUES (32), (40), (64), (128)) a(h) CROSS JOIN (VALUES (1), (2)) b(l)
  CROSS JOIN (VALUES (0.0), (0.1), (0.2), (0.3)) c(d) CROSS JOIN (VALUES (0.0001), (0.0005), (0.001)) e(r) CROSS JOIN (VALUES (90.0), (95.0), (99.0)) f(p)),
per AS (SELECT series_id, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM points GROUP BY 1)
SELECT series_id, h AS hidden, l AS layers, count(*) AS n_trials, round(sum(CASE p WHEN 90.0 THEN p90 WHEN 95.0 THEN p95 ELSE p99 END), 6) AS sum_threshold
FROM axes CROSS JOIN per GROUP BY 1, 2, 3""",
)
def grid_thresholds(spark, folder):
    """The full hyper-parameter grid against every series' percentile thresholds."""
    trials = sweep.grid_trials(spark)
    windows = s.event_windows(spark, folder)
    levels = exact_percentiles(windows.select("series_id", F.explode("values").alias("v")), s.BY, "v", [0.9, 0.95, 0.99])
    asked = trials.groupBy("hidden", "layers", "percentile").agg(F.count(F.lit(1)).alias("n"))
    met = levels.withColumn("percentile", F.round(F.col("fraction") * 100, 6)).join(F.broadcast(asked), "percentile")
    return met.groupBy("series_id", "hidden", "layers").agg(
        F.sum("n").alias("n_trials"), F.round(F.sum(F.col("n") * F.col("threshold")), 6).alias("sum_threshold")
    )


@query(
    "M13 M14 T2",
    s.SPLIT_SQL
    + """, trials AS (SELECT * FROM (VALUES (0, 8, 4, 6), (1, 12, 4, 4), (2, 6, 2, 2)) t(trial_id, tr, va, th)),
fanned AS (
  SELECT trial_id, series_id, tr, va, th, count(*) FILTER (NOT is_anomaly AND rn <= tr + va + th) AS n_used,
    count(*) FILTER (is_anomaly OR rn > tr + va + th) AS n_test
  FROM ranked CROSS JOIN trials GROUP BY ALL
)
SELECT trial_id, series_id, n_used, n_test FROM fanned""",
)
def wide_trial_splits(spark, folder):
    """Trials that use up to 20 development windows of a series: none is cut."""
    windows = s.labelled(spark, folder)
    trials = spark.createDataFrame([(0, 8, 4, 6), (1, 12, 4, 4), (2, 6, 2, 2)], "trial_id int, train int, val int, threshold int")
    fanned = sweep.fan_out(sweep.rank_normals(windows, 20), trials)
    used = F.col("split") != "test"
    return fanned.groupBy("trial_id", "series_id").agg(F.count_if(used).alias("n_used"), F.count_if(~used).alias("n_test"))


def _lists(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) for v in row) + ")" for row in rows)


@query(
    "M13",
    f"""WITH focused AS (SELECT row_number() OVER () - 1 AS trial_id, 'focused' AS kind, * FROM (VALUES {_lists(fv.FOCUSED_TRIALS)}) t(hidden, layers, dropout, rate, percentile)),
per AS (SELECT event_type AS series_id, list_sort(list(value::DOUBLE)) AS s FROM events GROUP BY 1)
SELECT f.trial_id::INTEGER AS trial_id, f.hidden::INTEGER AS hidden, f.layers::INTEGER AS layers, round(f.dropout, 4)::DOUBLE AS dropout,
  round(f.rate, 8)::DOUBLE AS rate, f.percentile::DOUBLE AS percentile, series_id, round({s.sql_percentile("f.percentile / 100.0")}, 6) AS threshold
FROM focused f CROSS JOIN per""",
)
def focused_trial_thresholds(spark, folder):
    """The focused trial list, each with the percentile of every series that it asks for."""
    trials = sweep.focused_trials(spark)
    wanted = sorted({row[-1] for row in fv.FOCUSED_TRIALS})
    values = s.events(spark, folder).select(F.col("event_type").alias("series_id"), "value")
    levels = exact_percentiles(values, s.BY, "value", [p / 100.0 for p in wanted])
    key = F.round(F.col("fraction") * 100, 6)
    out = trials.drop("threshold").join(levels.withColumn("percentile", key), "percentile")
    return out.select(
        "trial_id", "hidden", "layers", F.round("dropout", 4).alias("dropout"), F.round("rate", 8).alias("rate"), "percentile", "series_id", F.round("threshold", 6).alias("threshold")
    )


@query(
    "M13",
    """WITH n AS (SELECT unnest(range(0, 50)) AS id),
u AS (SELECT id, name, ('0x' || substr(md5('42:' || id || ':' || name), 1, 8))::BIGINT / 4294967296.0 AS u FROM n CROSS JOIN (VALUES ('hidden'), ('layers'), ('dropout'), ('percentile')) a(name)),
t AS (SELECT id::INTEGER AS trial_id, floor(%s + max(u) FILTER (name = 'hidden') * (%s + 1 - %s))::INTEGER AS hidden,
  floor(%s + max(u) FILTER (name = 'layers') * (%s + 1 - %s))::INTEGER AS layers,
  round(%s + max(u) FILTER (name = 'dropout') * (%s - %s), 2)::DOUBLE AS dropout,
  round(%s + max(u) FILTER (name = 'percentile') * (%s - %s), 1)::DOUBLE AS percentile
  FROM u GROUP BY id),
per AS (SELECT event_type AS series_id, list_sort(list(value::DOUBLE)) AS s FROM events GROUP BY 1),
limits AS (SELECT t.*, series_id, s, """
    % tuple(v for lo, hi in (fv.RANDOM_HIDDEN, fv.RANDOM_LAYERS, fv.RANDOM_DROPOUT, fv.RANDOM_PERCENTILE) for v in (lo, hi, lo))
    + s.sql_percentile("percentile / 100.0")
    + """ AS threshold FROM t CROSS JOIN per)
SELECT trial_id, hidden, layers, dropout, percentile, series_id, round(threshold, 6) AS threshold, len(list_filter(s, lambda x: x > threshold)) AS n_above FROM limits""",
)
def random_trial_table(spark, folder):
    """The seeded random trials, each with the threshold it asks for in every series and the events above it."""
    trials = settle(sweep.random_trials(spark)).df
    values = s.events(spark, folder).select(F.col("event_type").alias("series_id"), F.col("value").cast("double").alias("score"))
    wanted = sorted({r["percentile"] for r in trials.select("percentile").distinct().collect()})
    levels = exact_percentiles(values, s.BY, "score", [p / 100.0 for p in wanted]).select("series_id", "cut", "threshold")
    curve = cal.score_curve(values.withColumn("is_anomaly", F.lit(True)), levels, s.BY, bounded=False)
    numbers = F.array_position(F.array(*[F.lit(p) for p in wanted]), F.col("percentile")).cast("int") - 1
    out = trials.drop("threshold").withColumn("cut", numbers).join(curve.select("series_id", "cut", "threshold", F.col("tp").alias("n_above")), "cut")
    return out.select("trial_id", "hidden", "layers", "dropout", "percentile", "series_id", F.round("threshold", 6).alias("threshold"), "n_above")
