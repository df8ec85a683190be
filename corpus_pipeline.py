"""Training-data pipeline over ``documents``: quality rules, exact dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage reads all rows its predecessor wrote. All but the last return the columns of
``documents``; mixing repeats a document as often as it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, exact_dedup, mixing, quality_rules, similar
from tidemark.llm.common import table
from tidemark.llm.queries import tokenizer
from tidemark.session import fresh_folder, pin_utc


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays: SimHash by anchor-point covering, links checked on whole sets."""
    return similar.dedup(docs, method=similar.COVERED)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, lang, n_tokens, ids`` (little-endian 32-bit integers), and the hash of the decoded bytes."""
    coded = byte_bpe.encode(docs.select("doc_id", "source", "lang", "text"), tokenizer(spark))
    return coded.select(
        "doc_id",
        "source",
        "lang",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("mixing", mixed),
    ("byte-level BPE", encoded),
]

# SQL has no XXH64 of this seed and no tokenizer: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    pin_utc(spark)
    docs = table(spark, sf_dir, "documents")
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            path = fresh_folder(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
