"""Windows in sequence order: any arrival order, any trigger borders, gaps, idle series, restarts."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import jobs
from tidemark.streaming.ordered import BLOCK, ORDERED, OrderedWindows, keyed_state, ordered_windows_stream
from tidemark.streaming.windows import window_rows


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Map(dict):
    most = 0

    def exists(self):
        return bool(self)

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value
        self.most = max(self.most, len(self))

    def removeKey(self, key):
        del self[key]


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Map())

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    def getCurrentProcessingTimeInMs(self):
        return 1000


def processor(length=4, step=None, gate=None, idle=None, horizon=None, status=True, history=3):
    made = OrderedWindows(length, step or length, gate, idle, horizon, status, history)
    made.init(Handle())
    return made


def frames(ids, size=1000):
    ids = np.asarray(ids, dtype=np.int64)
    for a in range(0, len(ids), size):
        part = ids[a : a + size]
        yield pd.DataFrame({"series_id": "a", "sequence_id": part, "us": part * 10, "value": part.astype(float)})


def feed(made, ids, size=1000):
    out = list(made.handleInputRows(("a",), frames(ids, size), Clock()))
    return pd.concat(out) if out else pd.DataFrame(columns=["kind"])


def windows(out):
    rows = out[out.kind == "window"]
    return list(zip(rows.window_id, rows.start_us, rows.end_us, rows["values"]))


@pytest.mark.parametrize("step", [1, 4, 7])
def test_any_order_and_any_triggers_give_the_same_windows(step):
    n = 3 * BLOCK + 37
    want = windows(feed(processor(4, step), range(n)))
    assert len(want) == (n - 4) // step + 1 and want[1][3] == [float(step + i) for i in range(4)]
    rng = np.random.default_rng(step)
    for triggers in (1, 2, 9):
        made, got = processor(4, step), []
        for part in np.array_split(rng.permutation(n), triggers):
            got += windows(feed(made, part, size=100))
        assert sorted(got) == want
        assert made.n["waiting"] == 0 and not made.blocks and made.n["seen"] == n and made.n["late"] == 0


def test_repeats_and_late_rows_are_counted_and_dropped():
    made = processor()
    feed(made, [0, 1, 2, 5, 5, 6])
    out = feed(made, [1, 5, 3, 4, 7])
    assert [w[3] for w in windows(out)] == [[0.0, 1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0]]
    last = out[out.kind == "buffering"].iloc[0]
    assert (last.seen, last.late, last.waiting, last.missing, last.emitted) == (8, 3, 0, 0, 2)


def test_gaps_wait_or_are_given_up():
    patient, other = processor(), processor(horizon=BLOCK + 10)
    ids = [i for i in range(3 * BLOCK) if i not in (7, 8, BLOCK + 3)]
    assert len(windows(feed(patient, ids))) == 1 and patient.n["waiting"] == len(ids) - 7
    out = feed(other, ids)
    assert other.n["missing"] == 3 and other.n["waiting"] == 0
    assert [w[3] for w in windows(out)][1] == [4.0, 5.0, 6.0, 9.0]
    assert len(windows(feed(patient, [7, 8]))) > 200 and patient.n["next"] == BLOCK + 3


def test_one_hot_series_in_one_trigger_needs_one_block():
    """A million rows, blocks of rows swapped: neither rows nor state pile up."""
    n = 1_000_000
    order = np.arange(n).reshape(-1, 2, 500)[:, ::-1].ravel()
    made = processor(100, history=3, status=False)
    count = most = 0
    for out in made.handleInputRows(("a",), frames(order, 10_000), Clock()):
        count += len(out)
        most = max(most, len(out))
    assert count == n // 100 and most <= 1024
    assert made.blocks.most <= 12 and len(made.us) < 100 and len(made.recent) == 3
    assert sorted(k[0] for k in made.recent) == [n // 100 - 3, n // 100 - 2, n // 100 - 1]


def test_timer_moves_with_every_trigger_and_ends_once():
    made = processor(idle=5000)
    feed(made, range(6))
    feed(made, range(6, 9))
    assert made.handle.timers == [6000]
    ended = pd.concat(made.handleExpiredTimer(("a",), Clock(), None))
    assert ended.kind.tolist() == ["ended"] and ended.buffered.tolist() == [1] and ended.recent.tolist() == [[0, 1]]
    assert len(windows(feed(made, range(9, 12)))) == 1


def test_empty_and_negative_ids():
    made = processor()
    assert windows(feed(made, [])) == []
    out = feed(made, [-5, 0, 1])
    assert out[out.kind == "buffering"].iloc[0].late == 1


def add_file(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_stream_over_restarts_equals_one_run(spark, tmp_path):
    rows = spark.range(2500).selectExpr("if(id % 5 = 0, 'b', 'a') series_id", "id")
    rows = rows.selectExpr("series_id", "if(series_id = 'b', id div 5, id - id div 5 - 1) sequence_id", "timestamp_seconds(id * 1800) ts", "cast(id as double) value").cache()
    src, out, chk, one = (str(tmp_path / n) for n in ("src", "out", "chk", "one"))
    parts = rows.selectExpr("*", "pmod(hash(value), 4) part").cache()

    def run(source, target, checkpoint):
        raw = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        with keyed_state(spark):
            jobs.run_to_parquet(window_rows(ordered_windows_stream(raw, 48)), target, checkpoint)
        return sorted(map(tuple, spark.read.parquet(target).collect()))

    for i in range(4):
        add_file(parts.filter(F.col("part") == 3 - i).drop("part"), src)
        got = run(src, out, chk)
    add_file(rows, one)
    assert got == run(one, str(tmp_path / "out1"), str(tmp_path / "chk1"))
    assert len(got) == 2000 // 48 + 500 // 48
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_idle_series_ends_and_resumes(spark, tmp_path):
    rows = spark.range(10).selectExpr("'a' series_id", "id sequence_id", "timestamp_seconds(id * 1800) ts", "cast(id as double) value")
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    add_file(rows, src)
    raw = spark.readStream.schema(rows.schema).parquet(src)
    with keyed_state(spark):
        query = jobs.start(ordered_windows_stream(raw, 4, idle_seconds=2).writeStream.format("parquet").option("path", out), chk, every="1 second")

    def seen(kind):
        return spark.read.schema(ORDERED).parquet(out).filter(F.col("kind") == kind).collect() if (tmp_path / "out").exists() else []

    try:
        deadline = time.time() + 90
        while time.time() < deadline and not seen("ended"):
            time.sleep(1)
        add_file(rows.selectExpr("series_id", "sequence_id + 10 sequence_id", "ts", "value"), src)
        while time.time() < deadline and len(seen("window")) < 5:
            time.sleep(1)
    finally:
        query.stop()
    ended = min(seen("ended"), key=lambda r: r["seen"])
    assert (ended["seen"], ended["emitted"], ended["buffered"], ended["recent"]) == (10, 2, 2, [0, 1])
    got = sorted(seen("window"), key=lambda r: r["window_id"])
    assert [r["window_id"] for r in got] == [0, 1, 2, 3, 4] and got[2]["values"] == [8.0, 9.0, 0.0, 1.0]
