import datetime as dt
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tidemark-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def regular(spark):
    """A regular 30-minute series of 10,320 rows from 2014-07-01 as (series_id, ts, value)."""
    start = dt.datetime(2014, 7, 1, tzinfo=dt.timezone.utc)
    rows = [("a", start + dt.timedelta(minutes=30 * i), float(i % 48)) for i in range(10320)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp, value double").cache()


def dense(spark, arrays, series="a", start="2024-01-01", step=1800, **columns):
    """Dense windows from a list of vectors, consecutive in time."""
    origin = int(dt.datetime.fromisoformat(start).replace(tzinfo=dt.timezone.utc).timestamp())
    rows = []
    for i, x in enumerate(arrays):
        a = origin + i * len(x) * step
        extra = [columns[c][i] for c in columns]
        rows.append((series, i, a, a + (len(x) - 1) * step, [float(v) for v in np.asarray(x)], *extra))
    kinds = {bool: "boolean", str: "string", int: "long", float: "double"}
    more = "".join(f", {c} {kinds[type(v[0])]}" for c, v in columns.items())
    df = spark.createDataFrame(rows, "series_id string, window_id long, a long, b long, values array<double>" + more)
    return df.selectExpr(
        "series_id", "window_id", "timestamp_seconds(a) start_ts", "timestamp_seconds(b) end_ts", "values", *columns
    )
