import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import dense
from tidemark.config import GridSpec, ModelSpec, ScorerSpec, SplitSpec, TrainSpec
from tidemark.functions import lstm as net
from tidemark.operators import baseline, evaluate as ev, lstm, sweep
from tidemark.sources import artifacts


def plain_step(w, part, layer, x, h, c):
    n = len(h)
    a = w[f"{part}.{layer}.input"] @ x + w[f"{part}.{layer}.input_bias"] + w[f"{part}.{layer}.recurrent"] @ h + w[f"{part}.{layer}.recurrent_bias"]
    s = lambda v: 1 / (1 + np.exp(-v))
    i, f, g, o = s(a[:n]), s(a[n : 2 * n]), np.tanh(a[2 * n : 3 * n]), s(a[3 * n :])
    c = f * c + i * g
    return o * np.tanh(c), c


def plain_forward(theta, spec, x, free):
    w = net.unflatten(theta, spec)
    state = [(np.zeros(spec.hidden), np.zeros(spec.hidden)) for _ in range(spec.layers)]

    def run(part, v, state):
        out = []
        for layer in range(spec.layers):
            h, c = plain_step(w, part, layer, v, *state[layer])
            out.append((h, c))
            v = h
        return v, out

    for v in x:
        _, state = run("encoder", v, state)
    out, v = [], x[-1]
    for t in range(len(x)):
        top, state = run("decoder", v if free else x[len(x) - 1 - t], state)
        v = w["output.weight"] @ top + w["output.bias"]
        out.append(v)
    return np.array(out[::-1])


@pytest.mark.parametrize("spec", [ModelSpec(1, 3, 1), ModelSpec(2, 4, 2)])
def test_forward_against_plain_loop(spec):
    theta = net.initial(spec, 1)
    x = np.random.default_rng(0).normal(size=(3, 7, spec.input_dim))
    for free, fn in ((False, net.reconstruct), (True, net.generate)):
        got = fn(theta, spec, x)
        for i in range(3):
            assert np.allclose(got[i], plain_forward(theta, spec, x[i], free))


@pytest.mark.parametrize("spec", [ModelSpec(1, 3, 1, 0.0), ModelSpec(2, 3, 2, 0.0)])
def test_gradient_by_differences(spec):
    theta = net.initial(spec, 2)
    x = np.random.default_rng(1).normal(size=(2, 5, spec.input_dim))
    _, grad = net.squared_error_grad(theta, spec, x)
    for k in np.random.default_rng(3).choice(len(theta), 25, replace=False):
        d = np.zeros_like(theta)
        d[k] = 1e-5
        num = (net.squared_error_grad(theta + d, spec, x)[0] - net.squared_error_grad(theta - d, spec, x)[0]) / 2e-5
        assert np.isclose(grad[k], num, rtol=1e-4, atol=1e-6)


def test_parameter_counts():
    assert ModelSpec(hidden=24).parameter_count == 5209
    assert ModelSpec(hidden=64).parameter_count == 34369


def test_best_weights_and_early_stop():
    p = net.Progress(patience=2, min_delta=1e-6)
    stops = [p.update(np.array([float(i)]), 1.0, v) for i, v in enumerate([3.0, 1.0, 1.0, 1.0 - 1e-9])]
    assert stops == [False, False, False, True]
    assert p.best_epoch == 4 and p.best_theta[0] == 3.0


def waves(spark, n=12, length=16):
    t = np.arange(length)
    x = np.stack([np.sin(2 * np.pi * t / length + 0.05 * i) for i in range(n)])
    split = ["train"] * 8 + ["val"] * 2 + ["test"] * (n - 10)
    return dense(spark, x, split=split).withColumn("z", F.col("values")), x


def test_fit_grouped_learns_and_reconstructs(spark):
    windows, x = waves(spark)
    both = windows.unionByName(windows.withColumn("series_id", F.lit("b")))
    models = lstm.fit_grouped(both, ["series_id"], TrainSpec(epochs=25, rate=2e-2), ModelSpec(hidden=6, length=16))
    rows = models.collect()
    assert len(rows) == 2 and rows[0]["theta"] == rows[1]["theta"]
    assert rows[0]["train_history"][-1] < 0.7 * rows[0]["train_history"][0]
    assert rows[0]["total_params"] == len(rows[0]["theta"])
    saved = spark.createDataFrame(rows, models.schema)
    got = {(r["series_id"], r["window_id"]): r["x_hat"] for r in lstm.reconstruct(both, saved, ["series_id"]).collect()}
    want = net.reconstruct(np.array(rows[0]["theta"]), ModelSpec(hidden=6), x[:, :, None])[:, :, 0]
    assert len(got) == 24 and all(np.allclose(got[s, i], want[i]) for s in "ab" for i in range(12))


def test_fit_global_first_step_is_full_batch(spark):
    windows, x = waves(spark)
    spec, train = ModelSpec(hidden=4, length=16), TrainSpec(epochs=3, rate=1e-2)
    table, losses, held = lstm.fit_global(windows.repartition(3), train, spec)
    theta = net.initial(spec, train.seed)
    adam = net.Adam(train.rate, train.clip)
    for loss in losses:
        sse, grad = net.squared_error_grad(theta, spec, x[:8, :, None])
        assert np.isclose(loss, sse / (8 * 16))
        theta = adam.step(theta, grad / (8 * 16))
    assert len(held) == 3 and held[-1] < held[0]
    assert np.allclose(table.first()["theta"], theta)


def test_artifacts_round_trip(spark, tmp_path):
    spec = ModelSpec(hidden=3)
    lstm_table = lstm.model_table(spark, spec, net.initial(spec, 0))
    artifacts.save(lstm_table, str(tmp_path), "model", "m1")
    artifacts.save_config(spark, str(tmp_path), "m1", splits=SplitSpec(6, 2, 2), scorer=ScorerSpec(mode="window"))
    back = artifacts.load(spark, str(tmp_path), "model", "m1")
    assert back.select(*lstm_table.columns).first() == lstm_table.first()
    got = artifacts.load_config(spark, str(tmp_path), "m1", splits=SplitSpec, scorer=ScorerSpec)
    assert got == {"splits": SplitSpec(6, 2, 2), "scorer": ScorerSpec(mode="window")}
    assert artifacts.model_stats(back, []).first()["total_parameters"] == spec.parameter_count


def test_trial_tables(spark):
    assert sweep.focused_trials(spark).count() == 14
    grid = sweep.grid_trials(spark)
    assert grid.count() == 288 and grid.drop("trial_id").distinct().count() == 288
    splits = sweep.split_trials(spark).orderBy("trial_id").collect()
    assert len(splits) == 36 and splits[0][1:4] == (4, 2, 8) and all(sum(r[1:4]) == 14 and r["threshold"] >= 1 for r in splits)
    drawn = sweep.random_trials(spark, 50).collect()
    assert len(drawn) == 50 and drawn == sweep.random_trials(spark, 50).collect()
    assert all(16 <= r["hidden"] <= 128 and 1 <= r["layers"] <= 3 and 0 <= r["dropout"] <= 0.4 and 1e-4 <= r["rate"] <= 1e-2 and 85 <= r["percentile"] <= 99 for r in drawn)


def test_sweep_drops_trials_with_an_empty_split(spark, tmp_path):
    x = np.random.default_rng(0).normal(5, 1, (8, 12))
    windows = dense(spark, x, is_anomaly=[False] * 8, is_edge_case=[False] * 8)
    rows = [(0, 3, 2, 1, 8, 1, 0.0, 1e-3, 95.0), (1, 6, 3, 2, 8, 1, 0.0, 1e-3, 95.0)]
    trials = spark.createDataFrame(rows, sweep.TRIAL)
    out = sweep.run_sweep(windows, trials, GridSpec(length=12), ScorerSpec()).collect()
    assert [r["trial_id"] for r in out] == [0]
    sweep.write_report(spark.createDataFrame(out), trials, "f1_score", str(tmp_path / "report"))
    summary = spark.read.json(str(tmp_path / "report" / "summary")).first()
    assert (summary["configs_tested"], summary["completed_runs"], summary["progress_pct"]) == (2, 1, 50.0)


def test_sweep_takes_as_many_windows_as_a_trial_asks_for(spark):
    x = np.random.default_rng(0).normal(5, 1, (30, 12))
    windows = dense(spark, x, is_anomaly=[False] * 30, is_edge_case=[False] * 30)
    trials = spark.createDataFrame([(0, 20, 2, 2, 8, 1, 0.0, 1e-3, 95.0), (1, 4, 2, 12, 8, 1, 0.0, 1e-3, 95.0)], sweep.TRIAL)
    out = {r["trial_id"]: r for r in sweep.run_sweep(windows, trials, GridSpec(length=12), ScorerSpec(mode="window")).collect()}
    assert [out[i]["fp"] + out[i]["tn"] for i in (0, 1)] == [6, 12]


def test_metrics_with_zero_denominators(spark):
    rows = spark.createDataFrame([("a", False, False)], "k string, is_flagged boolean, is_anomaly boolean")
    m = ev.metrics(ev.confusion(rows, ["k"])).first()
    assert (m["precision"], m["recall"], m["f1_score"], m["f_beta_score"], m["accuracy"]) == (0, 0, 0, 0, 1)


def test_best_trial_keeps_the_earlier_of_equals(spark):
    rows = spark.createDataFrame([("x", 3, 0.5), ("x", 1, 0.9), ("x", 2, 0.9)], "g string, trial_id int, f1_score double")
    assert ev.best_trial(rows, "f1_score", ["g"]).first()["trial_id"] == 1
    assert [r["trial_id"] for r in ev.leaderboard(rows, "f1_score", 2).collect()] == [1, 2]


def test_histogram_closes_the_last_bin(spark):
    rows = spark.range(30).selectExpr("cast(id as double) v", "'k' k")
    got = {r["bin"]: r["n"] for r in ev.score_histogram(rows, ["k"], "v").collect()}
    want, _ = np.histogram(np.arange(30.0), bins=29)
    assert [got[i + 1] for i in range(29)] == list(want)


def series(spark, x):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, idx long, value double")


def test_smoothing_against_pandas(spark):
    x = np.random.default_rng(0).normal(50, 10, 30000)
    out = baseline.exponential_smoothing(series(spark, x)).orderBy("idx").toPandas()["smoothed"].to_numpy()
    want = pd.Series(x).ewm(span=48).mean().to_numpy()
    assert np.max(np.abs(out - want) / np.abs(want)) < 1e-12


def test_block_functions_do_not_see_borders(spark):
    x = np.random.default_rng(1).normal(size=400)
    rows, p = series(spark, x), pd.Series(x)
    a = baseline.rolling_features(rows, block=32).orderBy("idx").toPandas()
    assert np.allclose(a["rolling_mean"], p.rolling(10, min_periods=1).mean()) and np.allclose(a["diff"][1:], p.diff()[1:])
    b = baseline.moving_stats(rows, 12, block=16).orderBy("idx").toPandas()
    assert len(b) == 389 and np.allclose(b["moving_max"], p.rolling(12).max().dropna())
    c = baseline.prefix_sum(rows, block=32).orderBy("idx").toPandas()
    assert np.allclose(c["running_sum"], x.cumsum())
    acf = baseline.autocorrelation(rows, 50, block=64).orderBy("lag").toPandas()["acf"]
    d = x - x.mean()
    assert np.allclose(acf, [(d[: len(d) - k] * d[k:]).sum() / (d**2).sum() for k in range(50)])


def test_broadcast_models_equal_grouped_models(spark):
    """Few and many windows of a model, models of two shapes, a series without a model: both ways give the same rows."""
    rng = np.random.default_rng(5)
    counts = {"hot": 600, "warm": 17, "a": 3, "b": 1, "none": 2}
    rows = [(k, i, rng.normal(size=6).tolist()) for k, n in counts.items() for i in range(n)]
    windows = spark.createDataFrame(rows, "series_id string, window_id long, z array<double>")
    made = []
    for key, hidden, layers in (("hot", 3, 2), ("warm", 2, 1), ("a", 3, 2), ("b", 2, 1)):
        spec = ModelSpec(hidden=hidden, layers=layers, length=6)
        made.append((key, 1, hidden, layers, 0.0, net.initial(spec, len(made)).tolist()))
    models = spark.createDataFrame(made, "series_id string, input_dim int, hidden int, layers int, dropout double, theta array<double>")
    added = {"reconstruct": ["x_hat"], "generate": ["x_hat"], "encode": ["h", "c"]}
    for mode, names in added.items():
        out = []
        for limit in (1 << 20, 0):
            got = lstm.reconstruct(windows, models, ["series_id"], mode, limit).collect()
            out.append({(r["series_id"], r["window_id"]): np.concatenate([r[n] for n in names]) for r in got})
        assert out[0].keys() == out[1].keys() and len(out[0]) == sum(counts.values()) - counts["none"]
        assert all(np.allclose(v, out[1][k], atol=1e-12) for k, v in out[0].items())
    plan = lstm.reconstruct(windows, models, ["series_id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert lstm.reconstruct(windows.limit(0), models, ["series_id"]).count() == 0
    assert lstm.reconstruct(windows, models.limit(0), ["series_id"]).count() == 0
