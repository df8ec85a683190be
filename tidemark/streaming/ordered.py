"""Count windows over a stream in sequence order, whatever order and whatever triggers its rows come in.

Every series numbers its rows 0, 1, 2, .. (``sequence_id``). A row waits in state until all rows before it are
there; the waiting rows lie in blocks of ``BLOCK`` sequence ids, so a trigger reads and writes only the
blocks that its rows touch and the one that is next. Rows come as a series of Arrow batches and leave as
windows one run at a time: a series with millions of rows in one trigger costs one batch and one block of memory.

State per series: counters, fewer rows than a window is long, the waiting blocks, and the last ``history``
windows, older ones evicted. A timer marks a silent series as ended; it goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.windows import COLUMNS, OUTPUT, SLICE, _NUMBERS, valid_rows

# Sequence ids per entry of the waiting rows.
BLOCK = 1024
HISTORY = 3
ORDERED = OUTPUT + ", waiting long, missing long, recent array<long>"
_COLUMNS = [*COLUMNS, "waiting", "missing", "recent"]
_KINDS = _NUMBERS | {"waiting": "Int64", "missing": "Int64"}
_COUNTERS = ["next", "top", "seen", "emitted", "skipped", "late", "missing", "waiting", "timer"]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as several state variables need; the session's setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class OrderedWindows(StatefulProcessor):
    """Windows of ``length`` rows every ``step`` rows of one series, in the order of ``sequence_id``."""

    def __init__(self, length: int, step: int, gate, idle_ms: int | None, horizon: int | None, with_status: bool, history: int):
        self.length, self.step, self.gate, self.idle_ms = length, step, gate, idle_ms
        self.horizon, self.with_status, self.history = horizon, with_status, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", ", ".join(f"{c} long" for c in _COUNTERS))
        self.tail = handle.getValueState("tail", "us array<long>, numbers array<double>")
        self.blocks = handle.getMapState("waiting", "block long", "ids array<long>, us array<long>, numbers array<double>")
        self.recent = handle.getMapState("recent", "window_id long", "start_us long, end_us long")

    def _load(self) -> None:
        found = self.counters.get() if self.counters.exists() else (0, -1, 0, 0, 0, 0, 0, 0, 0)
        self.n = dict(zip(_COUNTERS, map(int, found)))
        us, numbers = self.tail.get() if self.tail.exists() else ([], [])
        self.us, self.numbers = np.asarray(us, dtype=np.int64), np.asarray(numbers, dtype=float)

    def _save(self) -> None:
        self.counters.update(tuple(self.n[c] for c in _COUNTERS))
        self.tail.update((self.us.tolist(), self.numbers.tolist()))

    def _frame(self, key, kind: str, windows: list[tuple], buffered: int = 0, recent: list[int] | None = None) -> pd.DataFrame:
        """Rows of one kind; ``windows`` has number, start, end, values and count so far of each."""
        n = self.n
        rows = [(key[0], kind, *w[:4], buffered, n["seen"], w[4], n["skipped"], n["late"], n["waiting"], n["missing"], recent) for w in windows]
        return pd.DataFrame(rows, columns=_COLUMNS).astype(_KINDS)

    def _status(self, key, kind: str) -> pd.DataFrame:
        kept = sorted(int(k[0]) for k in self.recent.keys()) if self.history and self.recent.exists() else []
        return self._frame(key, kind, [(None, None, None, None, self.n["emitted"])], len(self.us), kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for frame in rows:
            ids = frame["sequence_id"].to_numpy(np.int64)
            order = np.argsort(ids, kind="stable")
            ids, us, numbers = ids[order], frame["us"].to_numpy(np.int64)[order], frame["value"].to_numpy(float)[order]
            fresh = ids >= self.n["next"]
            fresh[1:] &= ids[1:] != ids[:-1]
            self.n["late"] += int((~fresh).sum())
            ids, us, numbers = ids[fresh], us[fresh], numbers[fresh]
            if len(ids):
                self.n["top"] = max(self.n["top"], int(ids[-1]))
            if len(ids) and not self.n["waiting"] and ids[0] == self.n["next"]:
                # Nothing waits: what goes on without a gap needs no state.
                run = self._run(ids)
                yield from self._take(key, us[:run], numbers[:run])
                ids, us, numbers = ids[run:], us[run:], numbers[run:]
            self._wait(ids, us, numbers)
            yield from self._release(key)
        if self.idle_ms:
            if self.n["timer"]:
                self.handle.deleteTimer(self.n["timer"])
            self.n["timer"] = int(timerValues.getCurrentProcessingTimeInMs()) + self.idle_ms
            self.handle.registerTimer(self.n["timer"])
        self._save()
        if self.with_status:
            yield self._status(key, "buffering")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        self.n["timer"] = 0
        self._save()
        yield self._status(key, "ended")

    def _run(self, ids: np.ndarray) -> int:
        """How many of the sorted ``ids`` follow one another from the next one on."""
        whole = ids == self.n["next"] + np.arange(len(ids))
        return len(ids) if whole.all() else int(whole.argmin())

    def _wait(self, ids: np.ndarray, us: np.ndarray, numbers: np.ndarray) -> None:
        """Put rows into their blocks; a sequence id that waits already is late."""
        block = ids // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            name, held = (int(block[a]),), (ids[a:b], us[a:b], numbers[a:b])
            before = self.blocks.getValue(name)
            if before is not None:
                held = tuple(np.concatenate([np.asarray(x, dtype=y.dtype), y]) for x, y in zip(before, held))
                first = np.unique(held[0], return_index=True)[1]
                self.n["late"] += len(held[0]) - len(first)
                self.n["waiting"] -= len(before[0])
                held = tuple(x[first] for x in held)
            self.n["waiting"] += len(held[0])
            self.blocks.updateValue(name, tuple(x.tolist() for x in held))

    def _release(self, key) -> Iterator[pd.DataFrame]:
        """Take waiting rows as long as the next one is there, or too far behind the newest one to be waited for."""
        while self.n["waiting"]:
            name = (self.n["next"] // BLOCK,)
            held = self.blocks.getValue(name)
            run = 0
            if held is not None:
                ids, us, numbers = (np.asarray(x, dtype=k) for x, k in zip(held, (np.int64, np.int64, float)))
                run = self._run(ids)
            if run:
                self.n["waiting"] -= run
                if run < len(ids):
                    self.blocks.updateValue(name, (ids[run:].tolist(), us[run:].tolist(), numbers[run:].tolist()))
                else:
                    self.blocks.removeKey(name)
                yield from self._take(key, us[:run], numbers[:run])
            elif self.horizon is not None and self.n["top"] - self.n["next"] >= self.horizon:
                first = min(self.blocks.keys())
                least = int(min(self.blocks.getValue(first)[0]))
                self.n["missing"] += least - self.n["next"]
                self.n["next"] = least
            else:
                break

    def _take(self, key, us: np.ndarray, numbers: np.ndarray) -> Iterator[pd.DataFrame]:
        """The next rows in order: windows that they complete leave in slices."""
        offset = self.n["seen"] - len(self.us)
        self.n["seen"] += len(us)
        self.n["next"] += len(us)
        t, v = np.concatenate([self.us, us]), np.concatenate([self.numbers, numbers])
        starts = np.arange((-offset) % self.step, len(t) - self.length + 1, self.step)
        kept = starts if self.gate is None or not len(starts) else starts[self.gate(t[starts])]
        self.n["skipped"] += len(starts) - len(kept)
        rest = int(starts[-1] + self.step) if len(starts) else 0
        self.us, self.numbers = t[rest:], v[rest:]
        for begin in range(0, len(kept), SLICE):
            rows = []
            for i in kept[begin : begin + SLICE]:
                self.n["emitted"] += 1
                end = int(t[i + self.length - 1])
                rows.append((int((offset + i) // self.step), int(t[i]), end, v[i : i + self.length].tolist(), self.n["emitted"]))
            yield self._frame(key, "window", rows)
        for i in kept[-self.history :] if self.history else ():
            self.recent.updateValue((int((offset + i) // self.step),), (int(t[i]), int(t[i + self.length - 1])))
        if self.history and len(kept):
            for old in sorted(int(k[0]) for k in self.recent.keys())[: -self.history]:
                self.recent.removeKey((old,))

    def close(self) -> None:
        pass


def ordered_windows_stream(
    rows: DataFrame,
    length: int,
    step: int | None = None,
    gate: Callable[[np.ndarray], np.ndarray] | None = None,
    idle_seconds: int | None = None,
    horizon: int | None = None,
    with_status: bool = False,
    history: int = HISTORY,
) -> DataFrame:
    """Windows of a stream ``series_id, sequence_id, ts, value`` whose sequence ids are 0, 1, 2, .. per series.

    The result does not depend on the order of the rows or on where triggers end. A repeated sequence id, or one that
    comes after the series has gone past it, is counted as ``late`` and dropped. ``horizon`` (None: wait for ever) gives up
    rows that are missing once one that many ids further on has come; they are counted as ``missing``, and the windows
    go on with the next row there is. ``step``, ``gate``, ``idle_seconds`` and ``with_status`` are as in ``count_windows_stream``;
    status rows carry the numbers of the last ``history`` windows. Start the query inside ``keyed_state``.
    """
    slim = valid_rows(rows).select("series_id", "sequence_id", F.unix_micros("ts").alias("us"), F.col("value").cast("double").alias("value"))
    processor = OrderedWindows(length, step or length, gate, idle_seconds * 1000 if idle_seconds else None, horizon, with_status, history)
    return slim.groupBy("series_id").transformWithStateInPandas(processor, ORDERED, "append", "ProcessingTime" if idle_seconds else "None")
