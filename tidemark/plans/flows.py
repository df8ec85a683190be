"""End-to-end flows composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import GridSpec, InjectSpec, LocaliseSpec, ModelSpec, ScorerSpec, SplitSpec, TrainSpec
from tidemark.operators import calibrate as cal
from tidemark.operators import evaluate as ev
from tidemark.operators import inject as inj
from tidemark.operators import localise as loc
from tidemark.operators import lstm
from tidemark.operators import score as sc
from tidemark.operators.grid import regular_windows
from tidemark.operators.labels import assign_splits, flag_edge_cases, flag_overlap
from tidemark.session import Sized, attach, settle


def prepare(
    buckets: DataFrame, labels: DataFrame | list, grid: GridSpec, splits: SplitSpec, edge_starts=(), min_fraction: float = 0.10
) -> DataFrame:
    """Slot counts to labelled, split, dense windows.

    The labelled windows are written once: the ranking behind the split reads only
    their key columns, and every later fit or score starts from them.
    """
    windows = regular_windows(buckets, grid)
    windows = flag_edge_cases(flag_overlap(windows, labels, grid, min_fraction), edge_starts)
    return assign_splits(settle(windows).df, splits)


def fit_profile_model(windows: DataFrame, grid: GridSpec, scorer: ScorerSpec, by: list[str]) -> Sized:
    """One parameter row per model: scaler, profile, error distribution, thresholds.

    Reads the development splits only, which are written once: a bounded number
    of windows per series.
    """
    dev = settle(windows.filter(F.col("split") != "test").select("series_id", "window_id", "split", "values")).df
    base = settle(sc.profile_fit(dev, by, grid.length))
    errors = sc.profile_errors(attach(dev, base, by)).select("series_id", "window_id", "split", "err")
    return fit_scorer(errors, base, scorer, by, grid.length)


def fit_scorer(errors: DataFrame, base: Sized, scorer: ScorerSpec, by: list[str], length: int) -> Sized:
    """Error distribution from the val split, threshold from the threshold split.

    ``errors`` has ``series_id, window_id, split, err`` of the development splits; the
    columns of ``base`` (one row per model) are carried into the result. Point mode fits
    the window statistics and the window threshold too, so that a reply can report it.
    A model lacks the parameters whose splits are empty or too short: they are null.
    """
    bounded = "series_id" in by
    fit_rows = errors.filter(F.col("split") == "val")
    held_out = errors.filter(F.col("split") == "threshold")
    if bounded:
        fitted = sc.window_fit(fit_rows, by, scorer.ridge)
    elif by:
        fitted = sc.keyed_window_fit(fit_rows, by, length, scorer.ridge)
    else:
        fitted = sc.pooled_window_fit(fit_rows, length, scorer.ridge)
    fitted = settle(fitted)
    scored = sc.window_scores(attach(held_out, fitted, by), scorer.ridge)
    parts = [fitted.df, sc.threshold_fit(scored, by, "window_score", scorer, bounded)]
    if scorer.mode == "point":
        points = settle(sc.point_fit(fit_rows, by, scorer.ridge))
        pool = sc.point_scores(attach(held_out, points, by)).select(*by, F.explode_outer("point_scores").alias("score"))
        limit = sc.threshold_fit(pool, by, "score", scorer, bounded).withColumnRenamed("threshold", "point_threshold")
        parts += [points.df, limit]
    out = base.df
    for part in parts:
        out = out.join(part, by, "left") if by else attach(out, part, [])
    # Thresholds and point statistics add a few numbers per model.
    return Sized(out, base.rows, base.bytes + fitted.bytes + 64 * base.rows)


def score_windows(windows: DataFrame, params: DataFrame | Sized, scorer: ScorerSpec, by: list[str]) -> DataFrame:
    """Reconstruct with the profile, score and flag. The one code path of batch and stream.

    Windows of a series without a complete model stay, with ``is_scored`` false.
    """
    return flag(sc.profile_errors(attach(windows, params, by, "left")), scorer)


def flag(errors: DataFrame, scorer: ScorerSpec) -> DataFrame:
    """Flags by the mode of ``scorer``; a missing column is an error, a missing value leaves the window unscored."""
    name = "point_threshold" if scorer.mode == "point" else "threshold"
    if name not in errors.columns:
        raise ValueError(f"{name} not set: fit it first")
    if scorer.mode == "point":
        scored = sc.point_scores(errors)
        over = F.size(F.filter("point_scores", lambda s: s > F.col("point_threshold")))
        scored = scored.withColumn("n_over", over)
        hit = F.col("n_over") >= scorer.hard_k
    else:
        scored = sc.window_scores(errors, scorer.ridge)
        hit = F.col("window_score") > F.col("threshold")
    ready = F.col("window_score").isNotNull() & F.col(name).isNotNull()
    return scored.withColumn("is_scored", ready).withColumn("is_flagged", F.when(ready, hit).otherwise(F.lit(False)))


def unscored(scored: DataFrame) -> DataFrame:
    """Windows and series that no complete model covers: ``series_id, n_windows``."""
    return scored.filter(~F.col("is_scored")).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_windows"))


def unscored_of(buckets: DataFrame, grid: GridSpec, splits: SplitSpec, scorer: ScorerSpec) -> DataFrame:
    """``unscored`` of unlabelled slot counts with one model per series: only series that may lack a parameter are made
    dense, fitted and scored.

    Without labels every window is a normal one: a series whose span holds all windows of the development splits, and
    which has no null slot, has every parameter, and all its windows are scored. A series without a window for the
    threshold split has no threshold, and none is scored. The others take the whole way.
    """
    by = ["series_id"]
    if splits.train < 1 or splits.val < 2 or splits.threshold < 1:
        raise ValueError("a complete model needs 1 train, 2 val and 1 threshold windows")
    kept = settle(buckets.filter(F.col("series_id").isNotNull() & F.col("slot").isNotNull())).df
    span = F.max("slot") - F.min("slot") - grid.offset_slots + 1
    spans = settle(kept.groupBy("series_id").agg(F.floor(span / grid.length).cast("long").alias("n_windows"), F.count_if(F.col("value").isNull()).alias("_null"))).df
    n, held = F.col("n_windows"), splits.train + splits.val
    doubtful = settle(spans.filter((n > held) & ((n < splits.used) | (F.col("_null") > 0))).select("series_id"))
    windows = prepare(attach(kept, doubtful, by), [], grid, splits)
    found = unscored(score_windows(windows, fit_profile_model(windows, grid, scorer, by), scorer, by))
    return spans.filter((n > 0) & (n <= held)).select("series_id", "n_windows").unionByName(found)


def evaluate(scored: DataFrame, by: list[str], beta: float = 0.1) -> DataFrame:
    """Metrics over the scored windows of the test split without the edge cases; ``unscored`` counts the rest."""
    rows = scored.filter((F.col("split") == "test") & ~F.col("is_edge_case") & F.col("is_scored"))
    return ev.metrics(ev.confusion(rows, by), beta)


def detect(
    windows: DataFrame, params: DataFrame | Sized, grid: GridSpec, scorer: ScorerSpec, by: list[str], where: LocaliseSpec = LocaliseSpec()
) -> DataFrame:
    """Score reply per window with a nested localisation for flagged ones: row by row, nothing is shuffled."""
    return replies(score_windows(windows, params, scorer, by), grid, where)


def replies(scored: DataFrame, grid: GridSpec, where: LocaliseSpec = LocaliseSpec(), keep: list[str] | None = None) -> DataFrame:
    """Score replies of scored windows; an unscored window has null score and is no anomaly."""
    placed = scored if "_place" in scored.columns else loc.located(scored, grid, where)
    place = F.when(
        F.col("is_flagged"),
        F.struct(
            F.col("_place.anomaly_start").alias("anomaly_start"),
            F.col("_place.anomaly_end").alias("anomaly_end"),
            F.col("_place.scale_hours").cast("double").alias("scale_hours"),
            F.col("_place.contrast_ratio").alias("contrast_ratio"),
        ),
    )
    return placed.select(
        "series_id",
        "window_id",
        F.col("is_flagged").alias("is_anomaly"),
        F.col("window_score").alias("anomaly_score"),
        F.col(reply_limit(scored)).alias("threshold"),
        F.col("start_ts").alias("window_start"),
        F.col("end_ts").alias("window_end"),
        place.alias("localization"),
        *(keep or []),
    )


def reply_limit(scored: DataFrame) -> str:
    """The reply reports the window threshold whenever there is one, even in point mode."""
    return "threshold" if "threshold" in scored.columns else "point_threshold"


def calibrate_with_injection(
    dev: DataFrame, params: DataFrame | Sized, inject: InjectSpec, scorer: ScorerSpec, by: list[str], length: int, method: str, beta: float = 1.0
) -> DataFrame:
    """Threshold from the threshold split and its corrupted copies.

    The copies are made in scaled units, as the windows are scored. Point mode
    calibrates the largest point score, window mode the window score.
    """
    normal = dev.filter(F.col("split") == "threshold").select("series_id", "window_id", "split", "values")
    ready = attach(normal, params, by).withColumn("z", sc.scaled("values")).withColumn("x_hat", F.col("profile"))
    corrupted = inj.inject(ready, inject, length, values="z")

    def scored(rows):
        rows = sc.with_errors(rows)
        if scorer.mode == "point":
            rows = sc.point_scores(rows)
        else:
            rows = sc.window_scores(rows, scorer.ridge)
        return rows.select("series_id", "window_id", F.col("window_score").alias("score"))

    labelled = settle(cal.labelled_union(scored(ready), scored(corrupted))).df
    if method == "percentile":
        return sc.threshold_fit(labelled.filter(~F.col("is_anomaly")), by, "score", scorer, "series_id" in by)
    return cal.calibrate(labelled, by, method, beta, "series_id" in by)


def fit_lstm_model(
    windows: DataFrame, grid: GridSpec, scorer: ScorerSpec, model: ModelSpec, train: TrainSpec, by: list[str]
) -> tuple[Sized, Sized, DataFrame]:
    """Scaler, LSTM, error distribution and threshold: ``(models, params, history)``.

    With a key one model per series is trained in parallel groups; without, one
    global model over all series. ``params`` has the scaler and the scorer.
    """
    dev = settle(windows.filter(F.col("split") != "test").select("series_id", "window_id", "split", "values")).df
    base = settle(sc.scaler_fit(dev, by))
    scaled = settle(attach(dev, base, by).withColumn("z", sc.scaled("values")).drop("values", "mean", "scale")).df
    if by:
        fitted = settle(lstm.fit_grouped(scaled, by, train, model))
        history = fitted.df.select(*by, "train_history", "val_history", "best_epoch")
        models = Sized(fitted.df.select(*by, *lstm.MODEL_COLUMNS), fitted.rows, fitted.bytes)
    else:
        table, losses, held = lstm.fit_global(scaled, train, model)
        models = settle(table)
        rows = [(losses, held, int(min(range(len(held)), key=held.__getitem__)) + 1)]
        history = windows.sparkSession.createDataFrame(rows, "train_history array<double>, val_history array<double>, best_epoch int")
    errors = settle(sc.with_errors(lstm.reconstruct(scaled.filter(F.col("split") != "train"), models, by)).drop("z", "x_hat")).df
    return models, fit_scorer(errors, base, scorer, by, grid.length), history


def score_lstm_windows(windows: DataFrame, models: DataFrame | Sized, params: DataFrame | Sized, scorer: ScorerSpec, by: list[str]) -> DataFrame:
    """Reconstruct with the LSTM, score and flag.

    Only the scaled vector and the keys go through Python; the scorer parameters
    are attached afterwards.
    """
    fixed = params if isinstance(params, Sized) or not by else settle(params)
    table = fixed.df if isinstance(fixed, Sized) else fixed
    scaler = table.select(*by, "mean", "scale")
    scaler = Sized(scaler, fixed.rows, fixed.bytes) if isinstance(fixed, Sized) else scaler
    scaled = attach(windows, scaler, by).withColumn("z", sc.scaled("values")).drop("mean", "scale")
    errors = sc.with_errors(lstm.reconstruct(scaled, models, by)).drop("z", "x_hat")
    return flag(attach(errors, fixed, by), scorer)


def with_injected_threshold(
    windows: DataFrame, models: DataFrame | Sized, params: Sized, inject: InjectSpec, scorer: ScorerSpec, by: list[str], length: int, method: str, beta: float = 1.0
) -> Sized:
    """LSTM parameters whose window threshold is calibrated on injected anomalies.

    Window mode. ``percentile`` as method keeps the fitted threshold.
    """
    if method == "percentile":
        return params
    normal = windows.filter(F.col("split") == "threshold").select("series_id", "window_id", "values")
    scaler = Sized(params.df.select(*by, "mean", "scale"), params.rows, params.bytes)
    ready = settle(attach(normal, scaler, by).withColumn("z", sc.scaled("values")).select("series_id", "window_id", "z")).df
    rest = Sized(params.df.drop("mean", "scale"), params.rows, params.bytes)

    def scored(rows):
        errors = sc.with_errors(lstm.reconstruct(rows.select("series_id", "window_id", "z"), models, by))
        return sc.window_scores(attach(errors, rest, by), scorer.ridge).select("series_id", "window_id", F.col("window_score").alias("score"))

    labelled = settle(cal.labelled_union(scored(ready), scored(inj.inject(ready, inject, length, values="z")))).df
    limit = cal.calibrate(labelled, by, method, beta, "series_id" in by).select(*by, "threshold")
    kept = params.df.drop("threshold")
    return Sized(kept.join(limit, by) if by else attach(kept, limit, []), params.rows, params.bytes)
