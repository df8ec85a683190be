import collections
import re

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tests.conftest import SF
from tests.llm import helpers
from tests.llm.test_dedup import plain_roots
from tests.llm.test_filters import plain_measures
from tests.llm.test_sampling_and_shards import plain_targets
from tidemark.llm import quality_rules

PLAIN = helpers.encoding()


def keeps(text):
    n, chars, symbols, lines, dup, repeated = plain_measures(text)
    failed = n < 50 or 100 * repeated > 50 * n or 10 * symbols > n or (lines >= 3 and 100 * dup > 40 * lines)
    return not (failed or chars < 2 * n or chars > 20 * n)


def test_stages_match_brute_force(spark):
    """Every stage on what its predecessor kept: equal, not a subset."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    stage = dict(corpus_pipeline.STAGES)

    docs = stage["quality rules"](spark, docs, SF)
    left = sorted(i for i, r in rows.items() if keeps(r["text"]))
    assert ids(docs) == left

    docs = stage["exact dedup"](spark, docs, SF)
    first = {}
    for i in left:
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", rows[i]["text"] or ""), i)
    left = sorted(first.values())
    assert ids(docs) == left

    docs = stage["simhash near-dedup"](spark, docs, SF)
    left = sorted({left[r] for r in plain_roots([rows[i]["text"] for i in left])})
    assert ids(docs) == left

    mixed = stage["mixing"](spark, docs, SF)
    copies = collections.Counter(ids(mixed))
    sizes, taken = collections.Counter(), collections.Counter()
    for i in left:
        n = plain_measures(rows[i]["text"])[0]
        sizes[rows[i]["source"]] += n
        taken[rows[i]["source"]] += n * copies[i]
    targets = plain_targets(dict(sizes))
    most = max(plain_measures(rows[i]["text"])[0] for i in left)
    assert set(copies) <= set(left) and all(abs(taken[s] - targets[s]) <= 2 * most for s in targets)

    coded = stage["byte-level BPE"](spark, mixed, SF).collect()
    assert collections.Counter(r["doc_id"] for r in coded) == copies
    for r in coded:
        assert np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist() == PLAIN.encode_ordinary(rows[r["doc_id"]]["text"])

    assert collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == copies


def test_stages_keep_the_columns(spark):
    docs = helpers.docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_registered(spark):
    found = __spark_entry__.queries()
    assert {f"op{i}_" for i in range(1, 14)} <= {n.split("_")[0] + "_" for n in found} and "pipeline" in found
    assert quality_rules.mask(1) == 3


@pytest.mark.parametrize("name", ["op1_mixed_sources", "op6_exact_copies", "op9_formatted_conversations", "op10_judged_documents", "op11_resampled_documents"])
def test_registered_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert helpers.rows_of(got.select(*names)) == sorted(want.fetchall(), key=repr)
