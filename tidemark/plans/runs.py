"""Whole runs: train and save, load and evaluate, refit the best trial of a sweep.

Every save publishes a new version of ``model_id`` with its five kinds of state:
``model``, ``scorer``, ``history``, ``splits`` and ``config``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import GridSpec, InjectSpec, ModelSpec, ScorerSpec, SplitSpec, TrainSpec
from tidemark.operators import evaluate as ev, score as sc
from tidemark.operators.labels import assign_splits
from tidemark.plans import flows
from tidemark.session import Sized, attach, settle
from tidemark.sources import artifacts, versions


def train_and_save(
    labelled: DataFrame, folder: str, model_id: str, grid: GridSpec, splits: SplitSpec, scorer: ScorerSpec, model: ModelSpec,
    train: TrainSpec, by: list[str], inject: InjectSpec | None = None, method: str = "midpoint",
) -> DataFrame:
    """Split, train, fit the scorer, save all state, and return the test metrics.

    ``labelled`` windows carry ``is_anomaly`` and ``is_edge_case``. With ``inject``
    the threshold comes from corrupted copies of the threshold split.
    """
    windows = assign_splits(settle(labelled).df, splits)
    models, params, history = flows.fit_lstm_model(windows, grid, scorer, model, train, by)
    if inject is not None:
        params = flows.with_injected_threshold(windows, models, params, inject, scorer, by, grid.length, method)
    _publish(windows, folder, model_id, models, params, history, splits=splits, scorer=scorer, model=model, train=train)
    scored = flows.score_lstm_windows(windows.filter(F.col("split") == "test"), models, params, scorer, by)
    return flows.evaluate(scored, by)


def _publish(windows: DataFrame, folder: str, model_id: str, fitted, params, history: DataFrame, **records) -> int:
    spark = windows.sparkSession
    kinds = {
        "model": fitted, "scorer": params, "history": history, "splits": windows.select("series_id", "window_id", "split"),
        "config": artifacts.config_table(spark, **records),
    }
    return versions.publish(spark, folder, model_id, kinds)


def load_and_score(labelled: DataFrame, folder: str, model_id: str, by: list[str], version: int | None = None) -> DataFrame:
    """Scored and flagged windows of every split, from the saved state of a version (the newest if none is named)."""
    state = versions.load(labelled.sparkSession, folder, model_id, version)
    config = artifacts.config_records(state["config"], splits=SplitSpec, scorer=ScorerSpec)
    windows = assign_splits(settle(labelled).df, config["splits"])
    if "profile" in state["model"].columns:
        params = state["model"].join(state["scorer"], by, "left") if by else attach(state["model"], state["scorer"], [])
        return flows.score_windows(windows, params, config["scorer"], by)
    return flows.score_lstm_windows(windows, state["model"], state["scorer"], config["scorer"], by)


def load_and_evaluate(labelled: DataFrame, folder: str, model_id: str, by: list[str], version: int | None = None) -> DataFrame:
    return flows.evaluate(load_and_score(labelled, folder, model_id, by, version), by)


def train_profile_and_save(
    labelled: DataFrame, folder: str, model_id: str, grid: GridSpec, splits: SplitSpec, scorer: ScorerSpec, by: list[str]
) -> DataFrame:
    """As ``train_and_save`` with the seasonal profile as reconstructor; returns all windows scored.

    The history of a profile is its mean absolute error on the train and val windows.
    """
    windows = settle(assign_splits(settle(labelled).df, splits)).df
    params = flows.fit_profile_model(windows, grid, scorer, by)
    params = Sized(settle(params.df).df, params.rows, params.bytes)
    fitted = windows.filter(F.col("split").isin("train", "val")).select(*by, "split", "values")
    errors = sc.profile_errors(attach(fitted, params, by)).select(*by, "split", F.explode("err").alias("_e"))
    history = errors.groupBy(*by).agg(*[F.avg(F.when(F.col("split") == s, F.col("_e"))).alias(f"{s}_loss") for s in ("train", "val")])
    model = params.df.select(*by, "mean", "scale", "profile")
    _publish(windows, folder, model_id, model, params.df.drop("mean", "scale", "profile"), history, splits=splits, scorer=scorer)
    return flows.score_windows(windows, params, scorer, by)


def refit_best(
    results: DataFrame, metric: str, labelled: DataFrame, folder: str, model_id: str, grid: GridSpec, train: TrainSpec, by: list[str], mode: str = "window",
    reconstructor: str = "lstm",
) -> DataFrame:
    """Train the best trial of a sweep again, save it and return its test metrics. One trial row reaches the driver.

    The LSTM gives one row per model, the profile (as its sweep does) one row pooled over the models.
    """
    best = ev.leaderboard(results, metric, 1).first()
    if best is None:
        raise ValueError("no trial finished")
    splits = SplitSpec(best["train"], best["val"], best["threshold"])
    scorer = ScorerSpec(percentile=best["percentile"], mode=mode)
    if reconstructor == "profile":
        return flows.evaluate(train_profile_and_save(labelled, folder, model_id, grid, splits, scorer, by), [])
    model = ModelSpec(hidden=best["hidden"], layers=best["layers"], dropout=best["dropout"], length=grid.length)
    again = TrainSpec(**{**vars(train), "rate": best["rate"]})
    return train_and_save(labelled, folder, model_id, grid, splits, scorer, model, again, by)
