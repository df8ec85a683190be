"""Trial tables and configuration sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import fixed_values as fv
from tidemark.config import GridSpec, ModelSpec, ScorerSpec, TrainSpec
from tidemark.functions.predicates import uniform
from tidemark.operators import evaluate as ev
from tidemark.operators import lstm, prefix_sweep
from tidemark.operators import score as sc
from tidemark.session import Sized, attach, settle

TRIAL = "trial_id int, train int, val int, threshold int, hidden int, layers int, dropout double, rate double, percentile double"
HYPER_SPLIT = (8, 2, 4)


def focused_trials(spark: SparkSession) -> DataFrame:
    rows = [(i, *HYPER_SPLIT, *row) for i, row in enumerate(fv.FOCUSED_TRIALS)]
    return spark.createDataFrame(rows, TRIAL)


def _numbered(df: DataFrame, *axes: str) -> DataFrame:
    """Number a few hundred driver-made trials in axis order."""
    order = Window.partitionBy(F.lit(0)).orderBy(*axes)
    return df.withColumn("trial_id", F.row_number().over(order) - 1)


def grid_trials(spark: SparkSession) -> DataFrame:
    """All combinations of the five axes, in axis order."""
    out = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in fv.GRID_HIDDEN])).alias("hidden"))
    for name, values in (("layers", fv.GRID_LAYERS), ("dropout", fv.GRID_DROPOUT), ("rate", fv.GRID_RATE), ("percentile", fv.GRID_PERCENTILE)):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    out = _numbered(out, "hidden", "layers", "dropout", "rate", "percentile")
    return _with_split(out)


def random_trials(spark: SparkSession, n: int = 50, seed: int = 42) -> DataFrame:
    """``n`` seeded draws from the five ranges."""

    def between(name, low, high):
        return low + uniform(F.lit(str(seed)), F.col("id").cast("string"), name) * (high - low)

    def whole(name, bounds):
        return F.floor(between(name, bounds[0], bounds[1] + 1)).cast("int")

    out = spark.range(n).select(
        F.col("id").cast("int").alias("trial_id"),
        whole("hidden", fv.RANDOM_HIDDEN).alias("hidden"),
        whole("layers", fv.RANDOM_LAYERS).alias("layers"),
        F.round(between("dropout", *fv.RANDOM_DROPOUT), 2).alias("dropout"),
        F.pow(F.lit(10.0), between("rate", *fv.RANDOM_RATE_EXPONENT)).alias("rate"),
        F.round(between("percentile", *fv.RANDOM_PERCENTILE), 1).alias("percentile"),
    )
    return _with_split(out)


def _with_split(df: DataFrame) -> DataFrame:
    for name, n in zip(("train", "val", "threshold"), HYPER_SPLIT):
        df = df.withColumn(name, F.lit(n))
    return df.select("trial_id", "train", "val", "threshold", "hidden", "layers", "dropout", "rate", "percentile")


def split_trials(
    spark: SparkSession, total: int = 14, min_train: int = 4, min_val: int = 2, min_threshold: int = 1,
    hidden: int = 64, rate: float = 1e-3, percentile: float = 95.0,
) -> DataFrame:
    """Every split of ``total`` development windows with the given minima."""
    out = spark.range(1).select(F.explode(F.sequence(F.lit(min_train), F.lit(total - min_val - min_threshold))).alias("train"))
    out = out.withColumn("val", F.explode(F.sequence(F.lit(min_val), total - F.col("train") - min_threshold)))
    out = out.withColumn("threshold", total - F.col("train") - F.col("val"))
    out = _numbered(out, "train", "val")
    return out.select(
        "trial_id", "train", "val", "threshold", F.lit(hidden).alias("hidden"), F.lit(1).alias("layers"), F.lit(0.2).alias("dropout"),
        F.lit(rate).alias("rate"), F.lit(percentile).alias("percentile"),
    )


def rank_normals(windows: DataFrame, max_used: int) -> DataFrame:
    """``rank`` of the first ``max_used`` normal windows of a series from 1, 0 for all others."""
    in_time = Window.partitionBy("series_id").orderBy("window_id")
    early = (
        windows.filter(~F.col("is_anomaly"))
        .select("series_id", "window_id", F.row_number().over(in_time).alias("rn"))
        .filter(F.col("rn") <= max_used)
    )
    used = early.groupBy("series_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "window_id"))), lambda x: x["window_id"]).alias("_used")
    )
    found = attach(windows, used, ["series_id"], "left")
    return found.withColumn("rank", F.coalesce(F.array_position("_used", F.col("window_id")), F.lit(0))).drop("_used")


def fan_out(ranked: DataFrame, trials: DataFrame) -> DataFrame:
    """Windows under every trial with that trial's ``split``: a trial cuts the one ranking at other places.

    The trial list is one small array; the copies are made row by row and never
    need a shuffle of their own.
    """
    listed = trials.agg(F.collect_list(F.struct(*trials.columns)).alias("_trials"))
    out = attach(ranked, listed, []).withColumn("_t", F.explode("_trials"))
    out = out.select(*ranked.columns, "_t.*")
    rank = F.col("rank")
    split = (
        F.when((rank == 0) | (rank > F.col("train") + F.col("val") + F.col("threshold")), "test")
        .when(rank <= F.col("train"), "train")
        .when(rank <= F.col("train") + F.col("val"), "val")
        .otherwise("threshold")
    )
    return out.withColumn("split", split).drop("rank")


def array_percentile(ordered: Column, fraction: Column) -> Column:
    """Linear interpolation in a sorted, bounded array at a fraction that is a column."""
    rank = fraction * (F.size(ordered) - 1)
    low = F.get(ordered, F.floor(rank).cast("int"))
    high = F.get(ordered, F.ceil(rank).cast("int"))
    return low + (high - low) * (rank - F.floor(rank))


NAMES = ["series_id", "window_id", "values", "is_anomaly", "is_edge_case"]


def _most_used(trials: DataFrame) -> int:
    """As many development windows as the largest trial asks for."""
    return trials.agg(F.max(F.col("train") + F.col("val") + F.col("threshold"))).first()[0] or 0


def run_sweep(
    windows: DataFrame, trials: DataFrame, grid: GridSpec, scorer: ScorerSpec, reconstructor: str = "profile",
    train: TrainSpec = TrainSpec(), beta: float = 0.1,
) -> DataFrame:
    """All trials in one set of jobs: one result row per trial, pooled over the series.

    ``windows`` are labelled (``is_anomaly``, ``is_edge_case``). A (series, trial)
    with an empty split has no model and drops out; ranking is left to
    ``evaluate.leaderboard`` and ``evaluate.best_trial``. With the profile every
    window is scored once for all trials (``prefix_sweep``); the LSTM is another model per trial.
    """
    if reconstructor == "profile":
        return _profile_sweep(windows, trials, scorer, beta)
    by = ["series_id", "trial_id"]
    ranked = rank_normals(settle(windows.select(*NAMES)).df, _most_used(trials))
    # Development windows: what the trial asks for, per series and trial.
    dev = settle(fan_out(ranked.filter(F.col("rank") > 0), trials).filter(F.col("split") != "test")).df
    rest = fan_out(ranked, trials).filter(F.col("split") == "test")
    base = settle(sc.scaler_fit(dev, by))
    scaled = attach(dev, base, by).withColumn("z", sc.scaled("values"))
    models = settle(lstm.fit_grouped(scaled, by, train, ModelSpec(length=grid.length)))
    info = models.df.select(*by, "train_loss", "val_loss", "best_epoch", "total_params")

    def errors_of(rows):
        slim = attach(rows, base, by).withColumn("z", sc.scaled("values")).select(*by, "window_id", "split", "is_anomaly", "is_edge_case", "percentile", "z")
        return sc.with_errors(lstm.reconstruct(slim, models, by))

    errors = settle(errors_of(dev).filter(F.col("split") != "train").select(*by, "window_id", "split", "percentile", "err")).df
    fit_rows, held_out = errors.filter(F.col("split") == "val"), errors.filter(F.col("split") == "threshold")
    if scorer.mode == "point":
        fitted = settle(sc.point_fit(fit_rows, by, scorer.ridge))
        scores_of = sc.point_scores
        pool = scores_of(attach(held_out, fitted, by)).select(*by, "percentile", F.explode_outer("point_scores").alias("s"))
    else:
        fitted = settle(sc.window_fit(fit_rows, by, scorer.ridge))

        def scores_of(rows):
            return sc.window_scores(rows, scorer.ridge)

        pool = scores_of(attach(held_out, fitted, by)).select(*by, "percentile", F.col("window_score").alias("s"))
    # The pool of one (series, trial) is its threshold split: bounded.
    ordered = pool.groupBy(*by).agg(F.array_sort(F.collect_list("s")).alias("_s"), F.first("percentile").alias("_p"))
    limits = settle(ordered.select(*by, array_percentile(F.col("_s"), F.col("_p") / 100.0).alias("limit")))
    final = Sized(fitted.df.join(limits.df, by), limits.rows, fitted.bytes + limits.bytes)
    test = scores_of(attach(errors_of(rest), final, by))
    if scorer.mode == "point":
        flagged = F.size(F.filter("point_scores", lambda s: s > F.col("limit"))) >= scorer.hard_k
    else:
        flagged = F.col("window_score") > F.col("limit")
    results = ev.metrics(ev.confusion(test.withColumn("is_flagged", flagged).filter(~F.col("is_edge_case")), ["trial_id"]), beta)
    summary = limits.df.groupBy("trial_id").agg(F.avg("limit").alias("mean_threshold"), F.count(F.lit(1)).alias("n_models"))
    losses = info.groupBy("trial_id").agg(
        F.avg("train_loss").alias("train_loss"), F.avg("val_loss").alias("val_loss"), F.max("best_epoch").alias("best_epoch"), F.max("total_params").alias("total_params")
    )
    return trials.join(results.join(summary, "trial_id").join(losses, "trial_id"), "trial_id")


def _profile_sweep(windows: DataFrame, trials: DataFrame, scorer: ScorerSpec, beta: float) -> DataFrame:
    listed = prefix_sweep.trial_list(trials)
    ranked = settle(rank_normals(settle(windows.select(*NAMES)).df, _most_used(trials))).df
    fits = settle(prefix_sweep.prefix_fits(ranked, listed, scorer))
    flags = prefix_sweep.trial_flags(prefix_sweep.score_trials(ranked, fits, listed, scorer), listed)
    results = ev.metrics(ev.confusion(flags.filter(~F.col("is_edge_case")), ["trial_id"]), beta)
    summary = prefix_sweep.trial_limits(fits.df).groupBy("trial_id").agg(F.avg("limit").alias("mean_threshold"), F.count(F.lit(1)).alias("n_models"))
    return trials.join(results.join(summary, "trial_id"), "trial_id")


def sweep_summary(results: DataFrame, trials: DataFrame, metric: str, beta: float = 0.1) -> DataFrame:
    """One row: how many trials were asked and finished, progress, metric and its beta, best configuration."""
    total = trials.agg(F.count(F.lit(1)).alias("configs_tested"))
    best = results.agg(
        F.count(F.lit(1)).alias("completed_runs"),
        F.max_by(F.struct(*results.columns), F.struct(metric, -F.col("trial_id"))).alias("best_config"),
    )
    both = attach(total, best, [])
    percent = F.when(F.col("configs_tested") > 0, F.round(100 * F.col("completed_runs") / F.col("configs_tested"), 1)).otherwise(0.0)
    return both.select("configs_tested", "completed_runs", percent.alias("progress_pct"), F.lit(metric).alias("sort_by"), F.lit(beta).alias("beta"), "best_config")


def write_report(results: DataFrame, trials: DataFrame, metric: str, path: str, beta: float = 0.1) -> None:
    """Sorted results and the summary as JSON."""
    fixed = settle(results).df
    fixed.orderBy(F.desc(metric), "trial_id").write.mode("overwrite").json(f"{path}/results")
    sweep_summary(fixed, trials, metric, beta).write.mode("overwrite").json(f"{path}/summary")
