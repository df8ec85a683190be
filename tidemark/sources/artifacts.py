"""Fitted state as Parquet tables, keyed by ``model_id``. No pickles."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import Sized


def save(table: DataFrame | Sized, folder: str, kind: str, model_id: str) -> None:
    """Write one kind of state (``model``, ``scorer``, ``history``, ``splits``) of one model set."""
    df = table.df if isinstance(table, Sized) else table
    df.write.mode("overwrite").parquet(f"{folder}/{kind}/model_id={model_id}")


def load(spark: SparkSession, folder: str, kind: str, model_id: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{kind}/model_id={model_id}")


def config_table(spark: SparkSession, **records) -> DataFrame:
    """Frozen parameter records as ``record, name, value`` rows."""
    rows = [(kind, name, repr(value)) for kind, rec in records.items() for name, value in vars(rec).items()]
    return spark.createDataFrame(rows, "record string, name string, value string")


def config_records(table: DataFrame, **kinds):
    """Back to records; ``kinds`` maps a record name to its class."""
    rows = table.collect()
    return {k: cls(**{r["name"]: ast.literal_eval(r["value"]) for r in rows if r["record"] == k}) for k, cls in kinds.items()}


def save_config(spark: SparkSession, folder: str, model_id: str, **records) -> None:
    save(config_table(spark, **records), folder, "config", model_id)


def load_config(spark: SparkSession, folder: str, model_id: str, **kinds):
    return config_records(load(spark, folder, "config", model_id), **kinds)


def scorer_stats(params: DataFrame | Sized, by: list[str], ridge: float) -> DataFrame:
    """Ranges, shape, condition number and thresholds of fitted scorers.

    The window covariance is I * ridge plus a low-rank part; with basis rows of
    squared length ``q`` its largest eigenvalue is ``ridge / (1 - q)``.
    """
    df = params.df if isinstance(params, Sized) else params
    out = [*by]
    for name in ("threshold", "point_threshold", "mu_point", "var_point", "n_fit"):
        if name in df.columns:
            out.append(F.col(name))
    if "basis" in df.columns:
        lengths = F.transform("basis", lambda b: F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
        worst = F.coalesce(F.array_max(lengths), F.lit(0.0))
        out += [
            F.array_min("mu").alias("mu_min"),
            F.array_max("mu").alias("mu_max"),
            F.size("mu").alias("window_length"),
            F.size("basis").alias("rank"),
            (1.0 / (1.0 - worst)).alias("condition_number"),
            F.lit(ridge).alias("ridge"),
        ]
    return df.select(*out)


def model_stats(models: DataFrame | Sized, by: list[str]) -> DataFrame:
    df = models.df if isinstance(models, Sized) else models
    return df.select(*by, "input_dim", "hidden", "layers", "dropout", F.size("theta").alias("total_parameters"))
