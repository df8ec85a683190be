"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query is
run to completion (all rows, all columns) after one untimed warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
# Model groups run one per task: NumPy must not start threads of its own.
os.environ.setdefault("OMP_NUM_THREADS", "1")

from pyspark.sql import SparkSession  # noqa: E402

from tidemark.plans import registry  # noqa: E402

HEADLINE = [
    "half_hour_grid",
    "count_windows_of_events",
    "sliding_window_bounds",
    "gated_sliding_windows",
    "label_overlap_windows",
    "many_intervals_overlap",
    "ordered_splits",
    "flagged_windows_by_points",
    "flagged_windows_by_distance",
    "detection_metrics",
    "pooled_percentiles",
    "localised_windows",
    "score_replies",
    "calibrated_f_score",
    "exponential_smoothing",
    "smoothing_best_threshold",
    "detector_comparison",
    "autocorrelation",
    "decoded_messages",
    "lstm_reconstruction",
    "split_sweep",
    "streamed_tumbling_windows",
    "streamed_sliding_windows",
    "streamed_scores",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        begin = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begin, 3)

    run("flagged_windows_by_points")
    only = sys.argv[1:] or HEADLINE
    times = {name: run(name) for name in only}
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name.replace("sf", "")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
