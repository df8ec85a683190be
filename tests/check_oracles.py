"""Runs registered queries next to their SQL and compares rows.

    SF=/root/testdata/sf0.01 python tests/check_oracles.py [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def text(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def main() -> int:
    folder = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", os.environ.get("PARTS", "8"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[1:] or list(queries):
        begin = time.time()
        try:
            df = queries[name](spark, folder)
            rows, names = df.collect(), df.columns
        except Exception as error:
            print("FAIL", name, str(error)[:1500])
            bad += 1
            continue
        took = f"{time.time() - begin:.2f}s"
        if name not in oracles:
            print("rows-only", name, len(rows), took)
            continue
        cur = con.execute(oracles[name])
        want_names, want = [d[0] for d in cur.description], cur.fetchall()
        cols = sorted(names)
        at = [want_names.index(c) if c in want_names else 0 for c in cols]
        a = sorted(tuple(text(r[c]) for c in cols) for r in rows)
        b = sorted(tuple(text(r[i]) for i in at) for r in want)
        same = cols == sorted(want_names) and a == b
        print("ok  " if same else "DIFF", name, len(a), len(b), took)
        if not same:
            bad += 1
            print("   columns", cols, sorted(want_names))
            print("   spark only", sorted(set(a) - set(b))[:4], len(set(a) - set(b)))
            print("   sql only", sorted(set(b) - set(a))[:4], len(set(b) - set(a)))
    print("bad", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
