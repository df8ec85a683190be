import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import dense
from tidemark.config import GridSpec, ScorerSpec
from tidemark.operators import prefix_sweep, sweep

TRIALS = [
    (0, 4, 2, 1, 8, 1, 0.0, 1e-3, 95.0), (1, 4, 5, 3, 8, 1, 0.0, 1e-3, 50.0), (2, 7, 3, 4, 8, 1, 0.0, 1e-3, 99.0),
    (3, 30, 2, 2, 8, 1, 0.0, 1e-3, 95.0), (4, 4, 1, 2, 8, 1, 0.0, 1e-3, 90.0), (5, 0, 3, 2, 8, 1, 0.0, 1e-3, 90.0),
]


def table(spark, sizes, length=12):
    """Series of several lengths, some anomalous and some edge windows, and one constant series."""
    rng = np.random.default_rng(3)
    out, raw = None, {}
    for name, n in sizes.items():
        x = 10 + np.sin(2 * np.pi * np.arange(length) / length) + 0.3 * rng.normal(size=(n, length))
        if name == "still":
            x[:] = 0.1
        odd = [bool(i % 11 == 5) for i in range(n)]
        edge = [bool(i % 13 == 7) for i in range(n)]
        x[np.array(odd)] += 2.0 if name != "still" else 0.0
        raw[name] = (x, odd, edge)
        one = dense(spark, x, series=name, is_anomaly=odd, is_edge_case=edge)
        out = one if out is None else out.unionByName(one)
    return out, raw


def plainly(raw, mode, ridge=1e-6, hard_k=5):
    """Every trial on its own, with an explicit covariance: counts and limits."""
    found = {}
    for trial, train, val, held, *_, percentile in TRIALS:
        counts, limits = np.zeros(4, dtype=int), []
        for x, odd, edge in raw.values():
            normal = [i for i, o in enumerate(odd) if not o][: train + val + held]
            a, b, c = normal[:train], normal[train : train + val], normal[train + val :]
            if not a or not c or len(b) < (2 if mode == "window" else 1):
                continue
            mean, scale = x[a].mean(), x[a].std()
            scale = 1.0 if scale < 1e-12 else scale
            err = np.abs((x - mean) / scale - ((x[a] - mean) / scale).mean(axis=0))
            if mode == "window":
                cov = np.atleast_2d(np.cov(err[b].T)) + ridge * np.eye(x.shape[1])
                d = err - err[b].mean(axis=0)
                score = np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T)
                limit = np.quantile(score[c], percentile / 100)
                flag = score > limit
            else:
                points = (err - err[b].mean()) ** 2 / (err[b].var() + ridge)
                limit = np.quantile(points[c], percentile / 100)
                flag = (points > limit).sum(axis=1) >= hard_k
            limits.append(limit)
            for i in set(range(len(x))) - set(normal):
                if not edge[i]:
                    counts[[[3, 1], [2, 0]][odd[i]][int(flag[i])]] += 1
        if limits:
            found[trial] = (tuple(counts.tolist()), np.mean(limits), len(limits))
    return found


@pytest.mark.parametrize("mode", ["window", "point"])
def test_every_trial_equals_its_plain_run(spark, mode):
    windows, raw = table(spark, {"long": 300, "short": 40, "tiny": 9, "none": 2})
    trials = spark.createDataFrame(TRIALS, sweep.TRIAL)
    got = {r["trial_id"]: r for r in sweep.run_sweep(windows, trials, GridSpec(length=12), ScorerSpec(mode=mode, hard_k=4)).collect()}
    want = plainly(raw, mode, hard_k=4)
    assert set(got) == set(want)
    for trial, (counts, limit, models) in want.items():
        row = got[trial]
        assert (row["tp"], row["fp"], row["fn"], row["tn"]) == counts, trial
        assert row["n_models"] == models and row["mean_threshold"] == pytest.approx(limit, rel=1e-6)


@pytest.mark.parametrize("mode", ["window", "point"])
def test_still_series_is_never_flagged(spark, mode):
    windows, _ = table(spark, {"still": 40})
    trials = spark.createDataFrame(TRIALS[:3], sweep.TRIAL)
    out = sweep.run_sweep(windows, trials, GridSpec(length=12), ScorerSpec(mode=mode)).collect()
    assert len(out) == 3 and all(r["tp"] == r["fp"] == 0 and r["mean_threshold"] == 0.0 for r in out)


def test_missing_values_and_empty_tables(spark):
    windows, _ = table(spark, {"a": 60})
    gap = F.when(F.col("window_id") == 50, F.transform("values", lambda v, i: F.when(i == 3, None).otherwise(v))).otherwise(F.col("values"))
    trials = spark.createDataFrame(TRIALS[:3], sweep.TRIAL)
    grid = GridSpec(length=12)
    for mode, lost in (("window", 1), ("point", 0)):
        scorer = ScorerSpec(mode=mode)
        whole = {r["trial_id"]: r for r in sweep.run_sweep(windows, trials, grid, scorer).collect()}
        holed = {r["trial_id"]: r for r in sweep.run_sweep(windows.withColumn("values", gap), trials, grid, scorer).collect()}
        total = lambda r: r["tp"] + r["fp"] + r["fn"] + r["tn"]
        assert all(total(holed[t]) == total(whole[t]) - lost for t in whole)
    assert sweep.run_sweep(windows.limit(0), trials, grid, ScorerSpec()).count() == 0
    assert sweep.run_sweep(windows, trials.limit(0), grid, ScorerSpec()).count() == 0


def test_no_window_is_copied_for_a_trial(spark):
    windows, _ = table(spark, {"a": 600, "b": 20})
    trials = spark.createDataFrame(TRIALS[:3], sweep.TRIAL)
    listed = prefix_sweep.trial_list(trials)
    ranked = sweep.rank_normals(windows.select(*sweep.NAMES), 14)
    scored = prefix_sweep.score_trials(ranked, prefix_sweep.prefix_fits(ranked, listed, ScorerSpec(mode="window")), listed, ScorerSpec(mode="window"))
    rows = scored.collect()
    assert len(rows) == 620 and all(len(r["scores"]) == len(r["flags"]) == 3 for r in rows)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan


def test_running_moments_keep_digits():
    x = 1e9 + np.random.default_rng(0).normal(size=(20, 48))
    count, mean, squares = prefix_sweep.running_moments(x)[13]
    assert count == 13 * 48 and mean == pytest.approx(x[:13].mean(), rel=1e-14)
    assert squares / count == pytest.approx(x[:13].var(), rel=1e-6)
