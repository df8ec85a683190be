"""Versions of fitted state, published by a manifest.

Layout of one model set: ``<folder>/<model_id>/<kind>/<unique>`` holds the tables,
``<folder>/<model_id>/manifest/version=<n>`` one small file that names the table
of every kind. Tables are written first and never overwritten; the manifest is
written last and appears by one rename, so a reader sees a version whole or not
at all, and a save that was cut short leaves the older versions as they were.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.session import Sized

MANIFEST = "kind string, path string, rows long"


def manifest(spark: SparkSession, folder: str, model_id: str) -> DataFrame:
    """``version, kind, path, rows`` of all published versions; none if nothing is published."""
    try:
        return spark.read.schema(f"{MANIFEST}, version int").parquet(f"{folder}/{model_id}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{MANIFEST}, version int")


def newest(spark: SparkSession, folder: str, model_id: str) -> int | None:
    return manifest(spark, folder, model_id).agg(F.max("version")).first()[0]


def publish(spark: SparkSession, folder: str, model_id: str, tables: dict[str, DataFrame | Sized], version: int | None = None) -> int:
    """Write all ``tables`` (kind to table) as one version and return its number.

    Without ``version`` it is the one after the newest. A number is published
    once: of two writers of the same number the later one gets an error, and its tables are in no manifest.
    """
    if not tables:
        raise ValueError("a version needs at least one table")
    number = (newest(spark, folder, model_id) or 0) + 1 if version is None else version
    rows = []
    for kind, table in tables.items():
        df = table.df if isinstance(table, Sized) else table
        watch, path = Observation(), f"{kind}/{uuid.uuid4().hex}"
        df.observe(watch, F.count(F.lit(1)).alias("rows")).write.mode("error").parquet(f"{folder}/{model_id}/{path}")
        rows.append((kind, path, watch.get["rows"]))
    listed = spark.createDataFrame(rows, MANIFEST).coalesce(1)
    listed.write.mode("error").parquet(f"{folder}/{model_id}/manifest/version={number}")
    return number


def load(spark: SparkSession, folder: str, model_id: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of a version by kind; the newest one without ``version``."""
    number = newest(spark, folder, model_id) if version is None else version
    found = manifest(spark, folder, model_id).filter(F.col("version") == number).collect() if number is not None else []
    if not found:
        raise ValueError(f"version {number} of {model_id} is not published" if number is not None else f"{model_id} has no version")
    return {r["kind"]: spark.read.parquet(f"{folder}/{model_id}/{r['path']}") for r in found}
