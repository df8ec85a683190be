import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import dense
from tidemark import fixed_values as fv
from tidemark.config import GridSpec, SplitSpec
from tidemark.functions import predicates as fn
from tidemark.operators import labels as lab
from tidemark.operators import segment
from tidemark.operators.grid import bucket, points, regular_windows


def test_golden_counts(spark, regular):
    spec = GridSpec(offset_days=5)
    windows = regular_windows(bucket(regular, "series_id", "ts", 1800, F.sum("value")), spec)
    windows = lab.flag_edge_cases(lab.flag_overlap(windows, fv.LABEL_INTERVALS, spec))
    rows = {r["name"]: r for r in segment.with_metadata(windows).collect()}
    assert len(rows) == 30
    assert sorted(n for n, r in rows.items() if r["is_anomaly"]) == ["2014-11-02", "2014-11-23", "2014-12-21", "2014-12-28", "2015-01-25"]
    assert [n for n, r in rows.items() if r["is_edge_case"]] and rows["2015-01-18"]["is_edge_case"]
    assert not rows["2014-10-26"]["is_anomaly"] and not rows["2015-01-18"]["is_anomaly"]


def test_row_windows_equal_grid_windows(spark, regular):
    kept = segment.offset_start(regular, 5)
    indexed = segment.dense_index(kept.withColumn("tie", F.lit(0)), ["ts", "tie"])
    assert indexed.filter("idx = 4944 - 240").select("ts").first()[0] == dt.datetime(2014, 10, 12)
    packed = segment.pack(segment.count_windows(indexed, 336), "ts", "value")
    grid = regular_windows(bucket(regular, "series_id", "ts", 1800, F.sum("value")), GridSpec(offset_days=5))
    a = {r["window_id"]: (r["start_ts"], r["end_ts"], r["values"]) for r in packed.collect()}
    b = {r["window_id"]: (r["start_ts"], r["end_ts"], r["values"]) for r in grid.collect()}
    assert a == b


def test_gated_sliding_windows(spark, regular):
    kept = segment.offset_start(regular, 5)
    cut = segment.count_windows(segment.dense_index(kept, ["ts"]), 336, keep_tail=True)
    packed = segment.pack(cut, "ts", "value")
    assert segment.sliding_windows(packed, 336, with_values=False).count() == 10080 - 335
    gated = segment.sliding_windows(packed, 336, gate=fn.passes_gate).collect()
    assert len(gated) == 22
    assert min(r["start_ts"] for r in gated) == dt.datetime(2014, 8, 31)
    assert all(len(r["values"]) == 336 and r["values"][:48] == [float(i) for i in range(48)] for r in gated)


def test_sliding_windows_do_not_cross_a_missing_tail(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(11)], "series_id string, t long, value double")
    rows = rows.withColumn("ts", F.timestamp_seconds("t"))
    packed = segment.pack(segment.count_windows(segment.dense_index(rows, ["ts"]), 4, keep_tail=True), "ts", "value")
    got = sorted((r["start_idx"], r["values"]) for r in segment.sliding_windows(packed, 4).collect())
    assert got == [(i, [float(i + k) for k in range(4)]) for i in range(8)]


@pytest.mark.parametrize("limit", [1000, 0])
@pytest.mark.parametrize("samples,expected", [(33, False), (34, True)])
def test_overlap_threshold(spark, samples, expected, limit):
    windows = dense(spark, [range(336)])
    end = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * (samples - 1))
    label = spark.createDataFrame([("2023-12-25 00:00:00", str(end))], "s string, e string").selectExpr("timestamp(s) start", "timestamp(e) end")
    out = lab.flag_overlap(windows, label, GridSpec(), inline_limit=limit).first()
    assert out["is_anomaly"] is expected
    listed = lab.flag_overlap(windows, [("2023-12-25 00:00:00", str(end))], GridSpec()).first()
    assert listed["is_anomaly"] is expected


@pytest.mark.parametrize("limit", [1000, 0])
def test_null_and_reversed_intervals_count_for_nothing(spark, limit):
    windows = dense(spark, [range(336)] * 3)
    rows = [(None, "2024-01-05 00:00:00"), ("2024-01-01 00:00:00", None), ("2024-01-05 00:00:00", "2024-01-01 00:00:00"), ("2024-01-08 00:00:00", "2030-01-01 00:00:00")]
    table = spark.createDataFrame(rows, "s string, e string").selectExpr("timestamp(s) start", "timestamp(e) end")
    out = lab.flag_overlap(windows, table, GridSpec(), inline_limit=limit).orderBy("window_id").collect()
    assert [r["is_anomaly"] for r in out] == [False, True, True]


def test_series_have_their_own_origin_and_keep_null_measures(spark):
    rows = [("a", s, 1.0) for s in range(4)] + [("b", 200, 2.0), ("b", 201, None), ("b", 203, 2.0)]
    buckets = spark.createDataFrame(rows, "series_id string, slot long, value double")
    got = {(r["series_id"], r["window_id"]): r["values"] for r in regular_windows(buckets, GridSpec(length=4)).collect()}
    assert got == {("a", 0): [1.0] * 4, ("b", 0): [2.0, None, 0.0, 2.0]}


def test_both_written_forms_of_a_time(spark):
    texts = ["2015/01/26 05:30:00.000", "2015/01/25 00:00:00.000", "2015-01-25T00:00:00", "never", "2014/08/24 00:00:00.000", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(fn.passes_text_gate(F.col("t"))).collect()] == [False, True, True, True, False, True]


def test_overlaps_of_several_intervals_are_not_added(spark):
    windows = dense(spark, [range(336)])
    two = [("2024-01-01 00:00:00", "2024-01-01 12:00:00"), ("2024-01-02 00:00:00", "2024-01-02 12:00:00")]
    assert lab.flag_overlap(windows, two, GridSpec()).first()["is_anomaly"] is False


def test_short_tail_is_dropped(spark):
    rows = spark.range(5 * 8 + 7).selectExpr("'a' series_id", "timestamp_seconds(id * 1800) ts", "id")
    indexed = segment.dense_index(rows, ["ts", "id"])
    assert segment.count_windows(indexed, 8).agg(F.max("window_id"), F.count("*")).first()[:] == (4, 40)
    grid = regular_windows(bucket(rows, "series_id", "ts", 1800), GridSpec(length=8))
    assert grid.count() == 5
    tail = regular_windows(bucket(rows, "series_id", "ts", 1800), GridSpec(length=8), keep_tail=True)
    assert points(tail, GridSpec(length=8)).count() == 47


def test_dense_index_splits_a_hot_series(spark):
    rows = spark.range(20000).selectExpr("if(id % 10 < 9, 'hot', 'cold') series_id", "timestamp_seconds(id div 5000) ts", "id")
    got = segment.dense_index(rows, ["ts", "id"])
    check = got.selectExpr("series_id", "idx", "total", "row_number() over (partition by series_id order by ts, id) - 1 want")
    assert check.filter("idx <> want").count() == 0
    assert {(r[0], r[1]) for r in check.select("series_id", "total").distinct().collect()} == {("hot", 18000), ("cold", 2000)}


def test_gap_filling(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1800 * 9), ("b", 1800 * 4)], "s string, t long").selectExpr("s", "timestamp_seconds(t) ts")
    got = {(r[0], r[1]): r[2] for r in regular_windows(bucket(rows, "s", "ts", 1800), GridSpec(length=5)).select("series_id", "window_id", "values").collect()}
    # A series has windows of its own span only: "b" has one slot.
    assert got == {("a", 0): [1, 0, 0, 0, 0], ("a", 1): [0, 0, 0, 0, 1]}


def test_splits(spark):
    flags = [False, True, False, False, False, True, False, False, False]
    windows = dense(spark, [range(4)] * 9, is_anomaly=flags)
    out = {r["window_id"]: (r["split"], r["order_id"]) for r in lab.assign_splits(windows, SplitSpec(3, 2, 1)).collect()}
    assert out == {
        0: ("train", 0), 2: ("train", 1), 3: ("train", 2), 4: ("val", 3), 6: ("val", 4), 7: ("threshold", 5),
        1: ("test", 6), 5: ("test", 7), 8: ("test", 8),
    }


def test_splits_truncate_silently(spark):
    windows = dense(spark, [range(4)] * 3, is_anomaly=[False, True, False])
    out = {r["window_id"]: r["split"] for r in lab.assign_splits(windows, SplitSpec(9, 3, 2)).collect()}
    assert out == {0: "train", 1: "test", 2: "train"}


def test_gate_on_text(spark):
    rows = spark.createDataFrame([("2014-08-31 00:00:59",), ("2014-08-24 00:00:00",), ("2014-09-07 00:30:00",), ("no time",), (None,)], "t string")
    assert [r[0] for r in rows.select(fn.passes_text_gate(F.col("t"))).collect()] == [True, False, False, True, True]


def test_group_limit_is_planned(spark):
    windows = dense(spark, [range(4)] * 3, is_anomaly=[False, True, False])
    from pyspark.sql.window import Window

    w = Window.partitionBy("series_id").orderBy("window_id")
    plan = windows.select("series_id", "window_id", F.row_number().over(w).alias("rn")).filter("rn <= 14")
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
