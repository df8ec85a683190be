import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import dense
from tidemark.config import GridSpec, InjectSpec, LocaliseSpec, ScorerSpec, SplitSpec
from tidemark.operators import calibrate as cal
from tidemark.operators import inject as inj
from tidemark.operators import localise as loc
from tidemark.operators import score as sc
from tidemark.operators.quantile import exact_percentiles, ranked_percentiles
from tidemark.operators.running import running_sums
from tidemark.plans import flows
from tidemark.session import attach


def errors(spark, x, split=None):
    cols = {"split": split} if split else {}
    return dense(spark, x, **cols).withColumnRenamed("values", "err")


@pytest.mark.parametrize("n,length", [(2, 12), (3, 30), (20, 6)])
def test_window_distance_equals_direct_inverse(spark, n, length):
    rng = np.random.default_rng(n)
    fit, new = rng.gamma(1.0, 0.2, (n, length)), rng.gamma(1.0, 0.3, (5, length))
    cov = np.cov(fit - fit.mean(axis=0), rowvar=False) + 1e-6 * np.eye(length)
    d = new - fit.mean(axis=0)
    want = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    for params, by in ((sc.window_fit(errors(spark, fit), ["series_id"], 1e-6), ["series_id"]), (sc.pooled_window_fit(errors(spark, fit), length, 1e-6), [])):
        out = sc.window_scores(attach(errors(spark, new), params, by), 1e-6)
        got = [r["window_score"] for r in out.orderBy("window_id").collect()]
        assert np.allclose(got, want, rtol=1e-5)


def test_one_fit_window_leaves_that_model_out_and_raises_for_a_global_one(spark):
    assert sc.window_fit(errors(spark, [[1.0, 2.0]]), ["series_id"], 1e-6).collect() == []
    with pytest.raises(Exception, match="at least two fit windows"):
        sc.pooled_window_fit(errors(spark, [[1.0, 2.0]]), 2, 1e-6).collect()


@pytest.mark.parametrize("mode", ["point", "window"])
def test_short_series_stay_unscored(spark, mode):
    rng = np.random.default_rng(3)
    split = ["train"] * 6 + ["val"] * 2 + ["threshold"] * 2 + ["test"] * 2
    full = dense(spark, rng.normal(size=(12, 6)), split=split, is_edge_case=[False] * 12, is_anomaly=[False] * 12)
    short = dense(spark, rng.normal(size=(7, 6)), series="short", split=split[:7], is_edge_case=[False] * 7, is_anomaly=[False] * 7)
    windows = full.unionByName(short)
    scorer = ScorerSpec(mode=mode)
    params = flows.fit_profile_model(windows, GridSpec(length=6), scorer, ["series_id"])
    scored = flows.score_windows(windows, params, scorer, ["series_id"]).cache()
    assert scored.count() == 19
    assert {(r["series_id"], r["n_windows"]) for r in flows.unscored(scored).collect()} == {("short", 7)}
    replies = flows.replies(scored, GridSpec(length=6)).collect()
    assert len(replies) == 19 and not any(r["is_anomaly"] for r in replies if r["series_id"] == "short")
    assert flows.evaluate(scored, ["series_id"]).count() == 1


def test_only_series_that_may_lack_a_model_are_fitted(spark, monkeypatch):
    """Spans of all lengths around the 4 windows that a model needs: as the whole way reports, with all but the doubtful series left out of the fit."""
    cells = [(f"s{n}", slot, float(slot % 5 + n)) for n in range(4, 31) for slot in (0, n // 2, n - 1)]
    cells += [("gap", i, None if i == 24 else 1.0) for i in range(30)]
    buckets = spark.createDataFrame(cells, "series_id string, slot long, value double").distinct()
    grid, split, scorer = GridSpec(step_seconds=60, length=5), SplitSpec(train=1, val=2, threshold=1), ScorerSpec(mode="point")
    windows = flows.prepare(buckets, [], grid, split)
    want = flows.unscored(flows.score_windows(windows, flows.fit_profile_model(windows, grid, scorer, ["series_id"]), scorer, ["series_id"])).collect()
    fitted, fit = [], flows.fit_profile_model
    monkeypatch.setattr(flows, "fit_profile_model", lambda w, *a: fitted.extend(w.select("series_id").distinct().collect()) or fit(w, *a))
    got = flows.unscored_of(buckets, grid, split, scorer).collect()
    assert sorted(got) == sorted(want) and {r["series_id"] for r in got} >= {f"s{n}" for n in range(5, 20)}
    assert {r["series_id"] for r in fitted} == {"gap"}


def test_constant_series_scales_by_one(spark):
    windows = dense(spark, [[5.0] * 4] * 2, split=["train", "train"])
    assert sc.scaler_fit(windows, ["series_id"]).first()["scale"] == 1.0
    assert sc.profile_fit(windows, ["series_id"], 4).first()["scale"] == 1.0


def test_empty_train_split_is_an_error(spark):
    windows = dense(spark, [[5.0] * 4], split=["test"])
    with pytest.raises(Exception, match="train split is empty"):
        sc.scaler_fit(windows, []).collect()


def test_profile_fit_agrees_with_scaler_fit(spark):
    x = np.random.default_rng(0).normal(100, 7, (6, 8))
    windows = dense(spark, x, split=["train"] * 5 + ["val"])
    p = sc.profile_fit(windows, ["series_id"], 8).first()
    assert np.isclose(p["mean"], x[:5].mean()) and np.isclose(p["scale"], x[:5].std())
    assert np.allclose(p["profile"], ((x[:5] - x[:5].mean()) / x[:5].std()).mean(axis=0))


def test_spec_defaults():
    assert ScorerSpec(percentile=0, sigma=0, hard_k=0) == ScorerSpec()
    with pytest.raises(ValueError):
        ScorerSpec(threshold_method="other")


def test_unset_threshold_is_an_error(spark):
    rows = errors(spark, [[1.0, 2.0]]).withColumn("mu", F.array(F.lit(0.0), F.lit(0.0))).withColumn("basis", F.expr("cast(array() as array<array<double>>)"))
    with pytest.raises(ValueError, match="threshold not set"):
        flows.flag(rows, ScorerSpec())
    with pytest.raises(Exception, match="threshold not set"):
        flows.flag(rows.withColumn("threshold", F.lit(None).cast("double")), ScorerSpec()).collect()


@pytest.mark.parametrize("accuracy", [100, 100_000])
@pytest.mark.parametrize("n", [1, 2, 7, 3000])
def test_exact_percentiles(spark, n, accuracy):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    x[: n // 3] = 0.25
    fractions = [0.0, 0.01, 0.25, 0.5, 0.9, 0.95, 0.9999, 1.0]
    rows = spark.createDataFrame([("a", float(v)) for v in x] + [("b", float(v) * 2) for v in x], "k string, v double")
    got = {(r["k"], r["cut"]): r["threshold"] for r in exact_percentiles(rows, ["k"], "v", fractions, accuracy).collect()}
    want = np.percentile(x, [100 * f for f in fractions])
    assert np.allclose([got["a", i] for i in range(8)], want) and np.allclose([got["b", i] for i in range(8)], 2 * want)
    for most in (1 << 20, 5):
        pooled = exact_percentiles(rows.filter("k = 'a'"), [], "v", fractions, accuracy, most).orderBy("cut").collect()
        assert np.allclose([r["threshold"] for r in pooled], want)


def test_keyed_fit_equals_the_grouped_one(spark, monkeypatch):
    """A key other than the series, weekly windows, one hot key; fewer keys held than there are."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(sc, "KEYS_HELD", 1)
    for length, n in ((336, 24), (5, 400)):
        x = rng.normal(size=(n, length)) * np.linspace(1, 3, length)
        df = errors(spark, x).withColumn("part", F.when(F.col("window_id") % 3 == 0, "a").when(F.col("window_id") == 1, None).otherwise("b")).filter("part is not null").repartition(5)
        one = {r["part"]: r for r in sc.window_fit(df, ["part"], 1e-3).collect()}
        two = {r["part"]: r for r in sc.keyed_window_fit(df, ["part"], length, 1e-3).collect()}
        assert set(one) == set(two) == {"a", "b"}
        for k in one:
            a, b = (np.array(r[k]["basis"]) for r in (one, two))
            assert one[k]["n_fit"] == two[k]["n_fit"] and np.allclose(one[k]["mu"], two[k]["mu"])
            assert np.allclose(a.T @ a, b.T @ b, atol=1e-7)
    assert sc.keyed_window_fit(df.limit(1), ["part"], 5, 1e-3).collect() == []


@pytest.mark.parametrize("bounded", [True, False])
def test_running_sums_of_a_hot_group(spark, bounded):
    """Nine rows of ten in one group, which lies on several range partitions."""
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 10 else "cold", float(v), int(i), int(i % 4)) for i, v in enumerate(rng.integers(0, 200, 4000))]
    df = spark.createDataFrame(rows, "k string, v double, i long, n long").repartition(6)
    got = running_sums(df, ["k"], ["v", "i"], ["n"], bounded).collect()
    total, want = {}, {}
    for k, v, i, n in sorted(rows):
        total[k] = total.get(k, 0) + n
        want[i] = total[k]
    assert {r["i"]: r["upto_n"] for r in got} == want
    assert running_sums(df.limit(0), [], ["v"], ["n"], bounded).collect() == []


@pytest.mark.parametrize("bounded", [True, False])
def test_score_curve_with_ties_and_nulls(spark, bounded):
    rng = np.random.default_rng(6)
    scores, truth = rng.integers(0, 9, 500).astype(float), rng.random(500) < 0.3
    rows = [(float(x), bool(t)) for x, t in zip(scores, truth)] + [(None, True), (float("nan"), False)]
    pool = spark.createDataFrame(rows, "score double, is_anomaly boolean")
    points = spark.createDataFrame([(0, -1.0), (1, 0.0), (2, 3.0), (3, 3.5), (4, 8.0), (5, 99.0), (6, 3.0)], "cut int, threshold double")
    got = {r["cut"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in cal.score_curve(pool, points, [], bounded).collect()}
    for r in points.collect():
        p = scores > r["threshold"]
        # A missing score is never above, one that is not a number always.
        want = ((p & truth).sum(), (p & ~truth).sum() + 1, (~p & truth).sum() + 1, (~p & ~truth).sum())
        assert got[r["cut"]] == tuple(int(x) for x in want)


def literal_localisation(e, spec, length):
    """The documented rule, step by step."""
    out = {}
    prefix = np.concatenate([[0.0], np.cumsum(e)])
    for h in spec.scales_hours:
        w = 2 * h
        if w > length:
            continue
        sums = prefix[w:] - prefix[: length - w + 1]
        top = int(np.argmax(np.round(sums, loc.TIE_DIGITS)))
        out[h] = (top, sums[top], sums.mean())
    h = 6 if 6 in out else min(out)
    w, best = 2 * h, None
    for t in range(length - w + 1):
        span = e[t : t + w]
        rank = (bool(span.mean() > 0 and (span >= 8 * span.mean()).any()), int((span > 0.2).sum()))
        if best is None or rank > best[0]:
            best = (rank, t)
    return best[1], h, out


@pytest.mark.parametrize("length", [8, 48])
def test_localisation_against_literal_rule(spark, length):
    rng = np.random.default_rng(length)
    x = rng.gamma(0.6, 0.15, (40, length))
    for i in range(0, 40, 3):
        x[i, rng.integers(length)] += 6.0
    x[1], x[2] = 0.0, 0.3
    spec = LocaliseSpec()
    found = loc.localise(errors(spark, x), GridSpec(length=length), spec)
    rows = {r["window_id"]: r for r in found.collect()}
    for i in range(40):
        start, h, scales = literal_localisation(x[i], spec, length)
        r = rows[i]
        assert (r["anomaly_start_idx"], r["scale_hours"]) == (start, h), i
        assert set(r["all_scales"]) == set(scales)
        for k, (top, peak, mean) in scales.items():
            assert r["all_scales"][k]["t_star"] == top and np.isclose(r["all_scales"][k]["peak_score"], peak)
        assert np.isclose(r["contrast_ratio"], scales[h][1] / scales[h][2] if scales[h][2] > 0 else 0.0)


def test_top_points_take_the_earlier_of_equals(spark):
    x = [[0.0] * 48]
    x[0][10] = x[0][12] = x[0][14] = x[0][16] = 5.0
    flagged = errors(spark, x).withColumn("values", F.col("err")).withColumn("window_score", F.lit(1.0))
    grid = GridSpec(length=48)
    top = loc.top_points(flagged.withColumn("is_flagged", F.lit(True)), grid, "err").orderBy("pos").collect()
    # Only a span with a single peak has a spike, the earliest is 0..11; equal zeros rank by position.
    assert [r["pos"] for r in top] == [0, 1, 10]


def literal_calibration(normal, anomalous, method):
    scores, truth = np.concatenate([normal, anomalous]), np.concatenate([np.zeros(len(normal)), np.ones(len(anomalous))]).astype(bool)
    if method == "midpoint":
        gap = anomalous.min() - normal.max()
        return (anomalous.min() + normal.max()) / 2 if gap > 0 else np.percentile(normal, 99)
    best, threshold = (0 if method == "f1_max" else -1), np.median(scores)
    for c in np.percentile(scores, np.arange(1, 100, 0.5)):
        p = scores > c
        tp, fp, fn, tn = (p & truth).sum(), (p & ~truth).sum(), (~p & truth).sum(), (~p & ~truth).sum()
        if method == "f1_max":
            pr, rc = tp / max(tp + fp, 1), tp / max(tp + fn, 1)
            o = 2 * pr * rc / (pr + rc) if pr + rc else 0
        else:
            o = tp / max(tp + fn, 1) + tn / max(tn + fp, 1) - 1
        if o > best + 1e-15:
            best, threshold = o, c
    return threshold


@pytest.mark.parametrize("method", ["midpoint", "f1_max", "youden"])
@pytest.mark.parametrize("shift", [0.5, 9.0])
def test_calibration(spark, method, shift):
    rng = np.random.default_rng(3)
    normal, anomalous = rng.normal(0, 1, 60), rng.normal(shift, 1, 25)
    rows = [("a", float(v), False) for v in normal] + [("a", float(v), True) for v in anomalous]
    scores = spark.createDataFrame(rows, "series_id string, score double, is_anomaly boolean")
    want = literal_calibration(normal, anomalous, method)
    for by, bounded in ((["series_id"], True), ([], False)):
        assert np.isclose(cal.calibrate(scores, by, method, bounded=bounded).first()["threshold"], want)


def test_unknown_calibration(spark):
    with pytest.raises(ValueError):
        cal.calibrate(spark.createDataFrame([], "score double, is_anomaly boolean"), [], "other")


def test_injection_shapes(spark):
    x = np.random.default_rng(1).normal(0, 1, (30, 48))
    windows = dense(spark, x, split=["threshold"] * 30)
    spec = InjectSpec(kinds=("point", "level_shift", "noise", "temporal"), copies=3, noise_scale=0.5)
    first = inj.inject(windows, spec, 48)
    again = inj.inject(windows.repartition(7), spec, 48)
    rows = first.collect()
    assert sorted(rows) == sorted(again.collect()) and len(rows) == 90
    assert {r["kind"] for r in rows} == set(spec.kinds)
    for r in rows:
        base, got = x[r["window_id"]], np.array(r["values"])
        moved = np.flatnonzero(~np.isclose(base, got))
        if r["kind"] == "point":
            assert len(moved) == 5 and np.allclose(np.abs(got - base)[moved], 3 * base.std())
        elif r["kind"] == "level_shift":
            assert len(moved) == 14 and np.ptp(moved) == 13 and np.allclose(np.abs(got - base)[moved], 2 * base.std())
        elif r["kind"] == "noise":
            assert 0 < len(moved) <= 14 and np.ptp(moved) <= 13
        else:
            assert np.allclose(got, np.roll(base, 12))


def test_large_parameters_take_a_plain_join(spark):
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) k", "id")
    params = rows.groupBy("k").agg(F.max("id").alias("m"))
    a = sorted(attach(rows, params, ["k"]).collect())
    assert a == sorted(attach(rows, params, ["k"], limit=0).collect())
    plan = attach(rows, params, ["k"], limit=0)._jdf.queryExecution().logical().toString()
    assert "hint" not in plan.lower() and "explode" not in plan.lower()


def test_global_model_flow(spark):
    """One pooled model over several series gives the numbers of a direct computation."""
    rng = np.random.default_rng(5)
    x = rng.normal(10, 2, (12, 6))
    split = ["train"] * 4 + ["val"] * 3 + ["threshold"] * 3 + ["test"] * 2
    windows = dense(spark, x, split=split)
    scorer = ScorerSpec(percentile=90.0, hard_k=1)
    params = flows.fit_profile_model(windows, GridSpec(length=6), scorer, [])
    got = flows.score_windows(windows, params, scorer, []).orderBy("window_id").collect()
    z = (x - x[:4].mean()) / x[:4].std()
    err = np.abs(z - z[:4].mean(axis=0))
    ps = (err - err[4:7].mean()) ** 2 / (err[4:7].var() + 1e-6)
    tau = np.percentile(ps[7:10], 90)
    assert np.allclose([r["window_score"] for r in got], ps.max(axis=1))
    assert [r["is_flagged"] for r in got] == list((ps > tau).sum(axis=1) >= 1)


def test_ranked_percentiles_equal_the_sorted_list(spark):
    """Distinct values with counts: ties, one value, a null and far more fractions than values give NumPy's interpolation."""
    rng = np.random.default_rng(7)
    groups = {"a": rng.integers(0, 40, 1000) / 8, "b": np.array([2.5]), "c": rng.normal(size=301), "d": np.repeat([1.0, 3.0], [1, 500])}
    rows = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("a", None)], "k string, v double")
    counted = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    fractions = [0.0, 1.0, 0.3333, *cal.CANDIDATE_FRACTIONS]
    got = {(r["k"], r["cut"]): r["threshold"] for r in ranked_percentiles(counted, ["k"], "v", "c", fractions).collect()}
    want = {(k, i): np.quantile(x, p) for k, x in groups.items() for i, p in enumerate(sorted(set(fractions)))}
    assert set(got) == set(want) and all(abs(got[at] - want[at]) < 1e-9 for at in want)
    alone = ranked_percentiles(counted.filter("k = 'c'").drop("k"), [], "v", "c", fractions).collect()
    assert {r["cut"]: r["threshold"] for r in alone} == {i: got["c", i] for i in range(len(set(fractions)))}
    assert ranked_percentiles(counted.limit(0), ["k"], "v", "c", fractions).collect() == []


def test_an_unbounded_pool_is_read_once(spark):
    """Collapsed scores are written: neither totals nor thresholds go over the pool again."""
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    pool = spark.range(400).selectExpr("id % 90 / 7.0D AS score", "id % 3 = 0 AS is_anomaly").mapInPandas(count, "score double, is_anomaly boolean")
    points = spark.createDataFrame([(0, 1.0), (1, 5.5)], "cut int, threshold double")
    assert cal.score_curve(pool, points, [], bounded=False).count() == 2 and seen.value == 400
    assert cal.score_candidates(pool, [], bounded=False).count() == 198 and seen.value == 800
