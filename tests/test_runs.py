import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import dense
from tidemark.config import GridSpec, InjectSpec, ModelSpec, ScorerSpec, SplitSpec, TrainSpec
from tidemark.operators import sweep
from tidemark.plans import detectors, flows, runs
from tidemark.session import settle
from tidemark.sources import versions


def labelled(spark, n=16, length=12):
    rng = np.random.default_rng(0)
    t = np.arange(length)
    x = np.stack([10 + np.sin(2 * np.pi * t / length) + 0.05 * rng.normal(size=length) for _ in range(n)])
    x[12] += 6
    flags = [i == 12 for i in range(n)]
    one = dense(spark, x, is_anomaly=flags, is_edge_case=[False] * n)
    return one.unionByName(one.withColumn("series_id", F.lit("b")))


def test_train_save_load_evaluate(spark, tmp_path):
    windows, grid = labelled(spark), GridSpec(length=12)
    scorer, model, train = ScorerSpec(mode="window", percentile=99.99), ModelSpec(hidden=4, length=12), TrainSpec(epochs=8, rate=2e-2)
    for by, name in ((["series_id"], "each"), ([], "one")):
        first = runs.train_and_save(windows, str(tmp_path), name, grid, SplitSpec(6, 3, 2), scorer, model, train, by).collect()
        again = runs.load_and_evaluate(windows, str(tmp_path), name, by).collect()
        assert sorted(first) == sorted(again) and all(r["recall"] == 1.0 for r in first)


def test_injected_threshold(spark, tmp_path):
    windows, grid = labelled(spark), GridSpec(length=12)
    scorer, model, train = ScorerSpec(mode="window"), ModelSpec(hidden=4, length=12), TrainSpec(epochs=4, rate=2e-2)
    inject = InjectSpec.with_magnitude(4.0)
    out = runs.train_and_save(windows, str(tmp_path), "m", grid, SplitSpec(6, 3, 2), scorer, model, train, ["series_id"], inject).collect()
    plain = runs.train_and_save(windows, str(tmp_path), "p", grid, SplitSpec(6, 3, 2), scorer, model, train, ["series_id"]).collect()
    assert len(out) == len(plain) == 2
    a = {r["series_id"]: r["threshold"] for r in versions.load(spark, str(tmp_path), "m")["scorer"].collect()}
    b = {r["series_id"]: r["threshold"] for r in versions.load(spark, str(tmp_path), "p")["scorer"].collect()}
    assert all(a[k] > b[k] for k in a)


def test_lstm_sweep_and_refit(spark, tmp_path):
    windows, grid = labelled(spark), GridSpec(length=12)
    rows = [(0, 6, 3, 2, 3, 1, 0.0, 1e-2, 99.0), (1, 5, 2, 3, 4, 2, 0.1, 1e-2, 95.0)]
    trials = spark.createDataFrame(rows, sweep.TRIAL)
    train = TrainSpec(epochs=3)
    results = settle(sweep.run_sweep(windows, trials, grid, ScorerSpec(mode="window"), "lstm", train)).df
    got = {r["trial_id"]: r for r in results.collect()}
    assert set(got) == {0, 1} and got[1]["total_params"] == ModelSpec(hidden=4, layers=2).parameter_count
    # One trial of the sweep equals the same configuration run alone.
    best = runs.refit_best(results, "f1_score", windows, str(tmp_path), "best", grid, train, ["series_id"])
    top = max(got.values(), key=lambda r: (r["f1_score"], -r["trial_id"]))
    sums = best.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]).first()
    assert [sums[c] for c in ("tp", "fp", "fn", "tn")] == [top[c] for c in ("tp", "fp", "fn", "tn")]


def test_detector_contract(spark):
    windows, grid = labelled(spark), GridSpec(length=12)
    from tidemark.operators.labels import assign_splits

    split = settle(assign_splits(windows, SplitSpec(6, 3, 2))).df
    scorer = ScorerSpec(mode="window")
    found = detectors.ProfileDetector(flows.fit_profile_model(split, grid, scorer, ["series_id"]), scorer, ("series_id",), 12)
    assert found.is_ready() and found.min_rows == 12
    stats = found.get_stats().collect()
    assert len(stats) == 2 and all(r["rank"] == 2 and r["condition_number"] > 1 for r in stats)
    flagged = found.detect(split.filter("window_id = 12")).select("is_flagged").collect()
    assert [r[0] for r in flagged] == [True, True]
    assert detectors.run(found, split).filter("is_flagged").count() == found.detect(split).filter("is_flagged").count() >= 2
    short = split.withColumn("values", F.slice("values", 1, 5))
    assert detectors.run(found, short).count() == 0
    unfitted = detectors.ProfileDetector(found.params.df.drop("threshold"), scorer, ("series_id",), 12)
    with pytest.raises(ValueError, match="fit it first"):
        detectors.run(unfitted, split)


def test_versions_are_whole_and_stay(spark, tmp_path):
    folder, one = str(tmp_path), spark.range(3)
    with pytest.raises(ValueError, match="no version"):
        versions.load(spark, folder, "m")
    assert versions.publish(spark, folder, "m", {"model": one, "history": spark.range(0)}) == 1
    assert versions.publish(spark, folder, "m", {"model": spark.range(5)}) == 2
    assert versions.load(spark, folder, "m", 1)["model"].count() == 3 and versions.load(spark, folder, "m")["model"].count() == 5
    assert versions.load(spark, folder, "m", 1)["history"].count() == 0
    # A number is published once, and a save that fails on its way publishes nothing.
    with pytest.raises(Exception, match="(?i)exist"):
        versions.publish(spark, folder, "m", {"model": spark.range(9)}, version=2)
    broken = spark.range(4).selectExpr("assert_true(id < 3) AS bad", "id")
    with pytest.raises(Exception, match="not true"):
        versions.publish(spark, folder, "m", {"model": spark.range(9), "scorer": broken})
    assert versions.newest(spark, folder, "m") == 2 and versions.load(spark, folder, "m", 2)["model"].count() == 5
    with pytest.raises(ValueError, match="not published"):
        versions.load(spark, folder, "m", 7)
    listed = {(r["version"], r["kind"]): r["rows"] for r in versions.manifest(spark, folder, "m").collect()}
    assert listed == {(1, "model"): 3, (1, "history"): 0, (2, "model"): 5}


def test_profile_run_keeps_five_kinds_and_older_versions(spark, tmp_path):
    windows, grid = labelled(spark), GridSpec(length=12)
    folder, by = str(tmp_path), ["series_id"]
    strict, loose = ScorerSpec(mode="window", percentile=99.99), ScorerSpec(mode="window", percentile=1.0)
    first = settle(runs.train_profile_and_save(windows, folder, "p", grid, SplitSpec(6, 3, 2), strict, by)).df
    runs.train_profile_and_save(windows, folder, "p", grid, SplitSpec(6, 3, 2), loose, by)
    assert set(versions.load(spark, folder, "p")) == {"model", "scorer", "history", "splits", "config"}
    key = lambda df: sorted(df.select("series_id", "window_id", "split", "is_flagged").collect())
    again = settle(runs.load_and_score(windows, folder, "p", by, version=1)).df
    newer = settle(runs.load_and_score(windows, folder, "p", by)).df
    assert key(again) == key(first) and newer.filter("is_flagged").count() > again.filter("is_flagged").count()
    history = versions.load(spark, folder, "p", 1)["history"].collect()
    assert len(history) == 2 and all(0 < r["train_loss"] < 1 and 0 < r["val_loss"] < 2 for r in history)
    whole = runs.load_and_evaluate(windows, folder, "p", by, 1).collect()
    assert len(whole) == 2 and all(r["recall"] == 1.0 for r in whole)
