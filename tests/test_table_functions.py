import datetime as dt

import pytest

from tidemark.operators import table_functions as tf

COLUMNS = "series_id string, idx long, ts timestamp, value double, block long"
CALL = "SELECT series_id, window_id, start_ts, end_ts, values FROM count_windows(TABLE({rows}) PARTITION BY (series_id, block) ORDER BY (idx), %s)"


def called(spark, rows, length="3"):
    tf.register(spark)
    return spark.sql(CALL % length, rows=rows)


def frame(spark, spec):
    """Rows of (series, idx, block), value = idx, shuffled."""
    made = [(k, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), None if i == 4 else float(i), b) for k, i, b in spec]
    return spark.createDataFrame(made, COLUMNS).repartition(5)


def test_windows_of_ordered_partitions(spark):
    rows = frame(spark, [("a", i, i // 6) for i in range(14)] + [("b", i, 0) for i in (0, 1, 3, 4, 5, 6, 8)] + [("c", 1, 0)])
    got = {(r["series_id"], r["window_id"]): r["values"] for r in called(spark, rows).collect()}
    assert got == {("a", 0): [0, 1, 2], ("a", 1): [3, None, 5], ("a", 2): [6, 7, 8], ("a", 3): [9, 10, 11], ("b", 1): [3, None, 5]}
    assert called(spark, rows.limit(0)).collect() == []


def test_hot_series_is_cut_at_window_borders(spark):
    n = tf.BLOCK_WINDOWS * 4 * 3 + 7
    start = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([("hot", i, start, i) for i in range(n)] + [(None, 1, start, 1)], "series_id string, event_id long, ts timestamp, value long")
    rows = tf.numbered(events, ["event_id"], 4)
    assert rows.select("block").distinct().count() == 4
    got = sorted((r["window_id"], r["values"]) for r in called(spark, rows, "4").collect())
    assert got == [(w, [4.0 * w + k for k in range(4)]) for w in range(n // 4)]


@pytest.mark.parametrize("length", ["0", "'x'", "idx"])
def test_arguments_are_checked(spark, length):
    with pytest.raises(Exception, match="(?i)window length|idx"):
        called(spark, frame(spark, [("a", 0, 0)]), length).collect()


def test_columns_are_checked(spark):
    with pytest.raises(Exception, match="value double"):
        called(spark, frame(spark, [("a", 0, 0)]).withColumnRenamed("value", "v")).collect()
