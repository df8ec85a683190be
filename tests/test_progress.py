from types import SimpleNamespace

import pytest

from tidemark.streaming.progress import ProgressLog, totals


def event(batch, read, run="r1", **seen):
    metrics = {"progress": SimpleNamespace(asDict=lambda: seen)} if seen else {}
    return SimpleNamespace(progress=SimpleNamespace(id="q1", runId=run, batchId=batch, numInputRows=read, observedMetrics=metrics))


def test_totals_outlive_a_restart(spark, tmp_path):
    folder = str(tmp_path / "log")
    first = ProgressLog(spark, folder)
    first.onQueryProgress(event(0, 10, rows=4, windows=1, ended=0, buffered=7))
    first.onQueryProgress(event(1, 20, rows=4, windows=2, ended=1, buffered=3))
    # A new driver reports batch 1 again, then goes on; the event of batch 2 was lost; batch 4 carries no counters.
    second = ProgressLog(spark, folder)
    second.onQueryProgress(event(1, 20, "r2", rows=4, windows=2, ended=1, buffered=3))
    second.onQueryProgress(event(3, 30, "r2", rows=5, windows=3, ended=0, buffered=9))
    second.onQueryProgress(event(4, 0, "r2"))
    row = totals(spark, folder).first().asDict()
    assert row == {
        "query_id": "q1", "input_rows": 60, "rows": 13, "windows": 6, "ended": 1, "buffered": 9, "triggers": 4, "runs": 2, "missing": 1,
    }


def test_what_the_listener_cannot_write_is_raised(spark, tmp_path):
    (tmp_path / "file").write_text("no folder")
    log = ProgressLog(spark, str(tmp_path / "file"))
    log.onQueryProgress(event(0, 1))
    query = SimpleNamespace(runId="r1")
    with pytest.raises(TimeoutError):
        log.wait(query, 0.01)
    log.onQueryTerminated(SimpleNamespace(runId="r1"))
    with pytest.raises(Exception, match="(?i)file|director"):
        log.wait(query, 1)
