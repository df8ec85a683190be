"""Exact deduplication: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.session import Sized, settle


def normalised(text: str = "text") -> Column:
    """Null counts as empty; every run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), F.lit(common.BLANK), F.lit(" "))


def _keys(docs: DataFrame, text: str) -> DataFrame:
    """Written once: id, 128-bit and 256-bit hash of the normalised text, a number that tells rows apart."""
    body = normalised(text).cast("binary")
    keys = docs.select("doc_id", F.md5(body).alias("_h"), F.sha2(body, 256).alias("text_sha256"))
    return settle(keys.withColumn("_row", F.monotonically_increasing_id())).df


def collisions(docs: DataFrame, text: str = "text") -> Sized:
    """The 128-bit hashes that texts of different bytes share.

    Texts are compared as grouping keys, byte by byte, and equal ones collapse before the
    shuffle: a hot group sends one row per task.
    """
    body = normalised(text)
    texts = docs.select(F.md5(body.cast("binary")).alias("_h"), body.alias("_body")).distinct()
    return settle(texts.groupBy("_h").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1").select("_h"))


def _grouped(keys: DataFrame, shared: Sized) -> DataFrame:
    # Groups whose bytes differ under one hash are told apart by the longer hash.
    by = ["_h", "text_sha256"] if shared.rows else ["_h"]
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    found = settle(keys.groupBy(*by).agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("group_size")))
    return common.join_checked(keys, found, by).select(
        "doc_id",
        F.col("_first.id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_first.row")).alias("kept"),
        "text_sha256",
    )


def groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The row with the smallest id of a group stays; of rows that repeat that id and text exactly one
    stays. Null ids are largest: they stay only in groups without any id. Null text equals empty
    text. An empty table gives an empty result; further columns are ignored.
    """
    return _grouped(_keys(docs, text), collisions(docs, text))


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns.

    A row that repeats both id and text of a kept one goes, whatever its other columns hold.
    """
    keys, shared = _keys(docs, text), collisions(docs, text)
    named = [common.null_safe(F.col("doc_id")).alias("_id"), F.col("text_sha256").alias("_s")]
    kept = settle(_grouped(keys, shared).filter("kept").select(*named))
    repeats = settle(keys.select(*named).groupBy("_id", "_s").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    packed = docs.select(
        common.null_safe(F.col("doc_id")).alias("_id"),
        F.sha2(normalised(text).cast("binary"), 256).alias("_s"),
        F.struct("*").alias("_all"),
    )
    stays = common.join_checked(packed, kept, ["_id", "_s"], "left_semi")
    if repeats.rows:
        once = common.join_checked(stays, repeats, ["_id", "_s"], "left_semi").dropDuplicates(["_id", "_s"])
        stays = common.join_checked(stays, repeats, ["_id", "_s"], "left_anti").unionByName(once)
    return stays.select("_all.*")
