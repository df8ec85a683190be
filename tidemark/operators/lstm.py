"""LSTM reconstruction and training as Spark jobs.

A model table has one row per model: the key columns, ``hidden``, ``layers``,
``dropout``, ``input_dim`` and the flat weights ``theta``. Windows carry a scaled
vector ``z`` (``input_dim`` values per step, step by step).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import ModelSpec, TrainSpec
from tidemark.functions import lstm as net
from tidemark.session import BROADCAST_BYTES, Sized, attach, settle

# Windows of one model that share a task call: bounds the size of a group.
CHUNK = 256
# Below that many windows of a model in a call, the weights of all its models are stacked, one set per window.
FEW = 16
MODEL_COLUMNS = ["input_dim", "hidden", "layers", "dropout", "theta"]


def model_table(spark: SparkSession, spec: ModelSpec, theta: np.ndarray) -> DataFrame:
    """A table of one global model."""
    row = (spec.input_dim, spec.hidden, spec.layers, float(spec.dropout), [float(v) for v in theta])
    return spark.createDataFrame([row], "input_dim int, hidden int, layers int, dropout double, theta array<double>")


def _spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition by the group keys into a fixed number of tasks.

    Model groups are small in bytes and heavy in arithmetic, so they must not be
    coalesced by size; the grouped operator reuses this partitioning.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _spec(row, length: int) -> ModelSpec:
    return ModelSpec(int(row["input_dim"]), int(row["hidden"]), int(row["layers"]), float(row["dropout"]), length)


def _stacked(column: pd.Series, width: int) -> np.ndarray:
    flat = np.stack(column.to_numpy())
    return flat.reshape(len(flat), -1, width)


def _vectors(a: np.ndarray) -> list:
    return list(a.reshape(len(a), -1))


def _apply(mode: str, pdf: pd.DataFrame, model) -> pd.DataFrame:
    """One call per ``CHUNK`` windows: bounds the arrays over time, whatever the batch size."""
    parts = [_apply_chunk(mode, pdf.iloc[i : i + CHUNK], model) for i in range(0, len(pdf), CHUNK)]
    return pd.concat(parts, ignore_index=True)


def _apply_chunk(mode: str, pdf: pd.DataFrame, model) -> pd.DataFrame:
    """``theta`` of the model is one vector, or one row of weights per window of ``pdf``."""
    theta = np.asarray(model["theta"], dtype=float)
    spec = _spec(model, 0)
    x = _stacked(pdf["z"], spec.input_dim)
    out = pdf.copy()
    if mode == "encode":
        state = net.encode(theta, spec, x)
        out["h"] = _vectors(np.concatenate([h for h, _ in state], axis=1))
        out["c"] = _vectors(np.concatenate([c for _, c in state], axis=1))
    else:
        out["x_hat"] = _vectors((net.generate if mode == "generate" else net.reconstruct)(theta, spec, x))
    return out


def _apply_many(mode: str, pdf: pd.DataFrame, models: list) -> pd.DataFrame:
    """Windows of many models (column ``_model``) in one call.

    Models of one shape share arrays. A model with many windows is one matrix product a step; of the others
    ``CHUNK`` windows at a time meet their weights stacked, bounded like the weights of ``CHUNK`` models.
    """
    number = pdf["_model"].to_numpy()
    rows = pdf.drop(columns="_model").reset_index(drop=True)
    parts, few = [], {}
    for m in np.unique(number):
        at = np.flatnonzero(number == m)
        if len(at) >= FEW:
            parts.append(_apply(mode, rows.iloc[at], models[m]))
        else:
            few.setdefault(tuple(models[m][c] for c in ("input_dim", "hidden", "layers")), []).append(at)
    for at in (np.concatenate(x) for x in few.values()):
        for i in range(0, len(at), CHUNK):
            some = at[i : i + CHUNK]
            stacked = {**models[number[some[0]]], "theta": np.stack([models[m]["theta"] for m in number[some]])}
            parts.append(_apply_chunk(mode, rows.iloc[some], stacked))
    return pd.concat(parts, ignore_index=True)


def _with_broadcast(windows: DataFrame, models: DataFrame, by: list[str], mode: str, schema: T.StructType) -> DataFrame:
    spark = windows.sparkSession
    rows = models.select(*by, *MODEL_COLUMNS).collect()  # below the limit of the caller
    shared = spark.sparkContext.broadcast([{**r.asDict(), "theta": np.asarray(r["theta"], dtype=float)} for r in rows])
    key_schema = T.StructType([*[models.schema[c] for c in by], T.StructField("_model", T.IntegerType())])
    numbers = spark.createDataFrame([(*[r[c] for c in by], i) for i, r in enumerate(rows)], key_schema)
    placed = windows.join(F.broadcast(numbers), by).select(*windows.columns, "_model")

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield _apply_many(mode, pdf, shared.value)

    return placed.mapInPandas(run, schema)


def reconstruct(windows: DataFrame, models: DataFrame | Sized, by: list[str], mode: str = "reconstruct", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``x_hat`` (modes ``reconstruct``, ``generate``) or ``h, c`` (mode ``encode``).

    One global model goes to the tasks with the function (its size is fixed by
    the model spec) and no row moves. Models per key, one row each, are broadcast when their
    measured size is below ``limit``: no window moves, and windows of many models are
    computed together (``_apply_many``). Above, windows meet their
    model in groups of at most ``CHUNK`` windows. Either way a hot series is split, and windows without a
    model are left out.
    """
    added = ["h", "c"] if mode == "encode" else ["x_hat"]
    schema = T.StructType([*windows.schema.fields, *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in added]])
    if not by:
        table = models.df if isinstance(models, Sized) else models
        first = table.select(*MODEL_COLUMNS).limit(2).collect()
        if len(first) != 1:
            raise ValueError("a global model table has exactly one row")
        model = first[0].asDict()

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    yield _apply(mode, pdf, model)

        return windows.mapInPandas(run, schema)
    fixed = models if isinstance(models, Sized) else settle(models)
    if fixed.bytes <= limit:
        return _with_broadcast(windows, fixed.df, by, mode, schema)
    keyed = windows.withColumn("_chunk", F.floor(F.col("window_id") / CHUNK))
    keys = keyed.select(*by, "_chunk").distinct()
    group = [*by, "_chunk"]
    # Renamed keys: both sides of the cogroup descend from the same windows.
    placed = attach(keys, fixed, by, limit=limit).select(*[F.col(c).alias(f"_m_{c}") for c in group], *MODEL_COLUMNS)

    def run_group(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if len(rows) == 0 or len(model) == 0:
            return pd.DataFrame(columns=schema.names)
        return _apply(mode, rows.drop(columns="_chunk"), model.iloc[0])

    renamed = [f"_m_{c}" for c in group]
    left, right = _spread(keyed, group), _spread(placed, renamed)
    return left.groupBy(*group).cogroup(right.groupBy(*renamed)).applyInPandas(run_group, schema)


def fit_grouped(windows: DataFrame, by: list[str], train: TrainSpec, model: ModelSpec) -> DataFrame:
    """Train one model per key, all keys in parallel.

    A group holds the train and val windows of one key: dozens by the split rule,
    never the open-ended test part. Mini-batches keep time order. Columns named
    ``hidden``, ``layers``, ``dropout`` or ``rate`` override the specs per key.
    """
    overrides = [c for c in ("hidden", "layers", "dropout", "rate") if c in windows.columns]
    schema = ", ".join(
        [
            *[f"{c} {windows.schema[c].dataType.simpleString()}" for c in by],
            "input_dim int, hidden int, layers int, dropout double, theta array<double>",
            "train_loss double, val_loss double, best_epoch int, epochs_run int, total_params int",
            "train_history array<double>, val_history array<double>",
        ]
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("window_id")
        asked = {c: pdf[c].iloc[0] for c in overrides}
        spec = ModelSpec(
            model.input_dim, int(asked.get("hidden", model.hidden)), int(asked.get("layers", model.layers)),
            float(asked.get("dropout", model.dropout)), model.length,
        )
        parts = {name: part for name, part in pdf.groupby("split")}
        if "train" not in parts or "val" not in parts:
            return pd.DataFrame()
        xs, xv = _stacked(parts["train"]["z"], spec.input_dim), _stacked(parts["val"]["z"], spec.input_dim)
        theta, rng = net.initial(spec, train.seed), np.random.default_rng(train.seed)
        adam = net.Adam(float(asked.get("rate", train.rate)), train.clip, train.weight_decay)
        progress = net.Progress(train.patience, train.min_delta)

        def batches(x):
            size = min(train.batch, len(x))
            return [x[i : i + size] for i in range(0, len(x), size)]

        for _ in range(train.epochs):
            losses = []
            for x in batches(xs):
                sse, grad = net.squared_error_grad(theta, spec, x, rng)
                losses.append(sse / x.size)
                theta = adam.step(theta, grad / x.size)
            held = [float(np.mean((net.reconstruct(theta, spec, x) - x) ** 2)) for x in batches(xv)]
            if progress.update(theta, float(np.mean(losses)), float(np.mean(held))):
                break
        best = progress.best_theta if progress.best_theta is not None else theta
        row = {c: pdf[c].iloc[0] for c in by}
        row.update(
            input_dim=spec.input_dim, hidden=spec.hidden, layers=spec.layers, dropout=spec.dropout, theta=best.tolist(),
            train_loss=progress.train[-1], val_loss=progress.val[-1], best_epoch=progress.best_epoch,
            epochs_run=len(progress.val), total_params=spec.parameter_count,
            train_history=progress.train, val_history=progress.val,
        )
        return pd.DataFrame([row])

    need = list(dict.fromkeys([*by, "window_id", "split", "z", *overrides]))
    dev = windows.filter(F.col("split").isin("train", "val")).select(*need)
    return _spread(dev, by).groupBy(*by).applyInPandas(fit, schema)


def fit_global(windows: DataFrame, train: TrainSpec, model: ModelSpec) -> tuple[DataFrame, list, list]:
    """Train one model on the windows of all series.

    The packed windows are written once. Every epoch is one job: tasks reduce
    their windows to a gradient vector, Spark adds those up per weight, and the
    driver, which sees only one number per weight, takes the optimiser step. A
    lost executor costs a retry of its part of one epoch.
    """
    fixed = settle(windows.filter(F.col("split").isin("train", "val")).select("split", "z")).df
    counts = {r["split"]: r["n"] for r in fixed.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get("train") or not counts.get("val"):
        raise ValueError("the train or val split is empty")
    cells = {k: n * model.length * model.input_dim for k, n in counts.items()}
    theta, adam = net.initial(model, train.seed), net.Adam(train.rate, train.clip, train.weight_decay)
    progress = net.Progress(train.patience, train.min_delta)
    n_weights = model.parameter_count

    def sums(rows: DataFrame, weights: np.ndarray, with_grad: bool) -> np.ndarray:
        def part(batches):
            total = np.zeros(1 + (n_weights if with_grad else 0))
            for pdf in batches:
                if not len(pdf):
                    continue
                stacked = _stacked(pdf["z"], model.input_dim)
                for i in range(0, len(stacked), CHUNK):
                    x = stacked[i : i + CHUNK]
                    if with_grad:
                        sse, grad = net.squared_error_grad(weights, model, x, np.random.default_rng(train.seed))
                        total[0] += sse
                        total[1:] += grad
                    else:
                        total[0] += float(((net.reconstruct(weights, model, x) - x) ** 2).sum())
            yield pd.DataFrame({"v": [total.tolist()]})

        parts = rows.select("z").mapInPandas(part, "v array<double>")
        added = parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        out = np.zeros(1 + (n_weights if with_grad else 0))
        got = added.toPandas()
        out[got["i"].to_numpy()] = got["v"].to_numpy()
        return out

    for _ in range(train.epochs):
        step = sums(fixed.filter(F.col("split") == "train"), theta, True)
        theta = adam.step(theta, step[1:] / cells["train"])
        held = sums(fixed.filter(F.col("split") == "val"), theta, False)
        if progress.update(theta, step[0] / cells["train"], held[0] / cells["val"]):
            break
    best = progress.best_theta if progress.best_theta is not None else theta
    return model_table(windows.sparkSession, model, best), progress.train, progress.val
