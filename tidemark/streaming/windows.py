"""Stateful count windows over a stream, in arrival order per series.

State per series is what the next window still needs: fewer rows than a window
is long, plus counters. Rows of one trigger are bounded by the source's admission
control (offsets or bytes per trigger).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

STATE = "seen long, last_seq long, skipped long, emitted long, late long, stamps array<long>, numbers array<double>"
OUTPUT = (
    "series_id string, kind string, window_id long, start_us long, end_us long, values array<double>, "
    "buffered int, seen long, emitted long, skipped long, late long"
)
COLUMNS = [part.split()[0] for part in OUTPUT.split(", ")]
_NUMBERS = {"window_id": "Int64", "start_us": "Int64", "end_us": "Int64", "buffered": "Int32", "seen": "Int64", "emitted": "Int64", "skipped": "Int64", "late": "Int64"}


# Windows per output frame.
SLICE = 1024


def sunday_gate(cutoff: str) -> Callable[[np.ndarray], np.ndarray]:
    """Vector form of the calendar gate on start times in microseconds (UTC)."""
    first = np.datetime64(cutoff, "us").astype("int64")

    def gate(us: np.ndarray) -> np.ndarray:
        minutes = us // 60_000_000
        days = minutes // 1440
        # Day 0 was a Thursday.
        return ((days + 4) % 7 == 0) & (minutes % 1440 == 0) & (us >= first)

    return gate


def valid_rows(rows: DataFrame) -> DataFrame:
    """Rows that can be placed: series, sequence id and time are there. ``rejected_rows`` has the others."""
    return rows.filter("series_id IS NOT NULL AND sequence_id IS NOT NULL AND ts IS NOT NULL")


def rejected_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("series_id IS NULL OR sequence_id IS NULL OR ts IS NULL")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype(_NUMBERS)


def count_windows_stream(
    rows: DataFrame,
    length: int,
    step: int | None = None,
    gate: Callable[[np.ndarray], np.ndarray] | None = None,
    idle_seconds: int | None = None,
    with_status: bool = False,
    drop_late: bool = False,
) -> DataFrame:
    """Windows of ``length`` rows of a stream ``series_id, sequence_id, ts, value``.

    ``step = length`` (default) tumbles, ``step = 1`` slides. ``gate`` is asked with
    all start times first; vectors are built for kept starts only. The order of rows is
    (trigger, sequence id). A row whose id is not above all ids of earlier triggers is ``late``: it
    is counted and takes its place in arrival order, or, with ``drop_late`` (a source that replays), is counted and
    dropped. ``valid_rows`` is applied; send ``rejected_rows`` to a sink of their own.
    With ``idle_seconds`` a silent series yields an ``ended`` row and goes on where it stopped when rows
    come again; ``with_status`` adds a ``buffering`` row with the counters per trigger.
    """
    step = step or length
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_seconds else GroupStateTimeout.NoTimeout

    def advance(key, batches, state):
        if state.hasTimedOut:
            seen, _, skipped, emitted, late, stamps, _ = state.get
            yield _frame([(key[0], "ended", None, None, None, None, len(stamps), seen, emitted, skipped, late)])
            return
        if state.exists:
            seen, last, skipped, emitted, late, stamps, numbers = state.get
        else:
            seen, last, skipped, emitted, late, stamps, numbers = 0, None, 0, 0, 0, [], []
        # Narrow columns only: the rows of one trigger are bounded by the source's admission in bytes.
        parts = [(b["sequence_id"].to_numpy("int64"), b["us"].to_numpy("int64"), b["value"].to_numpy(float)) for b in batches]
        ids, us, values = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(ids, kind="stable")
        if last is not None:
            behind = ids[order] <= last
            late += int(behind.sum())
            if drop_late:
                order = order[~behind]
        if drop_late and len(order):
            order = order[np.append(True, np.diff(ids[order]) != 0)]
        if len(order):
            last = int(max(ids[order[-1]], ids[order[-1]] if last is None else last))
        offset = seen - len(stamps)
        seen += len(order)
        t = np.concatenate([np.asarray(stamps, dtype="int64"), us[order]])
        v = np.concatenate([np.asarray(numbers, dtype=float), values[order]])
        # Starts are multiples of `step` in the series' own numbering.
        first = (-offset) % step
        starts = np.arange(first, len(t) - length + 1, step)
        kept = starts if gate is None or not len(starts) else starts[gate(t[starts])]
        skipped += len(starts) - len(kept)
        rest = int(starts[-1] + step) if len(starts) else 0
        left_t, left_v = t[rest:], v[rest:]
        state.update((int(seen), last, int(skipped), int(emitted + len(kept)), int(late), left_t.tolist(), left_v.tolist()))
        if idle_seconds:
            state.setTimeoutDuration(idle_seconds * 1000)
        # Finished windows leave in slices, so that sliding windows are never all vectors at once.
        for begin in range(0, len(kept), SLICE):
            yield _frame(
                [
                    (key[0], "window", int((offset + i) // step), int(t[i]), int(t[i + length - 1]), v[i : i + length].tolist(), 0, seen, emitted + n + 1, skipped, late)
                    for n, i in enumerate(kept[begin : begin + SLICE], begin)
                ]
            )
        if with_status:
            yield _frame([(key[0], "buffering", None, None, None, None, len(left_t), seen, emitted + len(kept), int(skipped), late)])

    slim = valid_rows(rows).select("series_id", "sequence_id", F.unix_micros("ts").alias("us"), F.col("value").cast("double").alias("value"))
    return slim.groupBy("series_id").applyInPandasWithState(advance, OUTPUT, STATE, "append", timeout)


def window_rows(stream: DataFrame) -> DataFrame:
    """The finished windows of ``count_windows_stream`` in the batch schema."""
    return stream.filter(F.col("kind") == "window").select(
        "series_id", "window_id", F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros("end_us").alias("end_ts"), "values"
    )


def deduplicated(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Optional: drop repeated (series, sequence id) pairs within a watermark."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["series_id", "sequence_id"])
