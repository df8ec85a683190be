"""Scaling, seasonal-profile reconstruction, error distribution and scoring.

Parameters are one row per model (``by`` names the key, ``[]`` is one global
model). Fits read only the development splits, a bounded number of windows per
series; scoring is row-local once the parameter row is attached.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import ScorerSpec
from tidemark.functions.predicates import dot
from tidemark.operators.quantile import exact_percentiles
from tidemark.session import attach, settle


def scaler_fit(windows: DataFrame, by: list[str], values: str = "values") -> DataFrame:
    """Pooled mean and population deviation of the train split; a constant series gets scale 1."""
    pooled = windows.filter(F.col("split") == "train").select(*by, F.explode(values).alias("_v"))
    fitted = pooled.groupBy(*by).agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("_std"))
    if not by:
        empty = F.raise_error(F.lit("cannot fit the scaler: the train split is empty"))
        fitted = fitted.withColumn("mean", F.coalesce("mean", empty.cast("double")))
    return fitted.select(*by, "mean", F.when(F.col("_std") == 0, 1.0).otherwise(F.col("_std")).alias("scale"))


def scaled(values: Column | str) -> Column:
    return F.transform(values, lambda v: (v - F.col("mean")) / F.col("scale"))


def unscaled(z: Column | str) -> Column:
    return F.transform(z, lambda v: v * F.col("scale") + F.col("mean"))


def profile_fit(windows: DataFrame, by: list[str], length: int, split: str = "train", values: str = "values") -> DataFrame:
    """Scaler and seasonal profile in one pass.

    Per-position moments are combined to the pooled mean and variance, so the
    windows are read once; the profile is kept in scaled units.
    """
    rows = windows.filter(F.col("split") == split) if split else windows
    by_pos = rows.select(*by, F.posexplode(values).alias("pos", "_v")).groupBy(*by, "pos").agg(
        F.count("_v").alias("n"), F.avg("_v").alias("m"), F.var_pop("_v").alias("s")
    )
    packed = by_pos.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "n", "m", "s"))).alias("_by_pos"))
    zero = F.lit(0.0)
    total = F.aggregate("_by_pos", zero, lambda a, x: a + x["n"])
    packed = packed.withColumn("_n", total)
    packed = packed.withColumn("mean", F.aggregate("_by_pos", zero, lambda a, x: a + x["n"] * x["m"]) / F.col("_n"))
    spread = F.aggregate("_by_pos", zero, lambda a, x: a + x["n"] * (x["s"] + F.pow(x["m"] - F.col("mean"), 2))) / F.col("_n")
    packed = packed.withColumn("_std", F.sqrt(spread))
    packed = packed.withColumn("scale", F.when(F.col("_std") == 0, 1.0).otherwise(F.col("_std")))
    if not by:
        packed = packed.filter(F.size("_by_pos") > 0)
    return packed.select(
        *by, "mean", "scale", F.transform("_by_pos", lambda x: (x["m"] - F.col("mean")) / F.col("scale")).alias("profile")
    )


def profile_errors(windows: DataFrame) -> DataFrame:
    """``z``, ``x_hat`` and absolute error vectors with the profile as reconstruction."""
    return with_errors(windows.withColumn("z", scaled("values")).withColumn("x_hat", F.col("profile")))


def with_errors(windows: DataFrame) -> DataFrame:
    return windows.withColumn("err", F.zip_with("z", "x_hat", lambda a, b: F.abs(a - b)))


def point_fit(errors: DataFrame, by: list[str], ridge: float) -> DataFrame:
    """Pooled mean and population variance (plus ridge) of all fit points."""
    return errors.select(*by, F.explode_outer("err").alias("_e")).groupBy(*by).agg(
        F.avg("_e").alias("mu_point"), (F.var_pop("_e") + F.lit(ridge)).alias("var_point")
    )


def feature_fit(rows: DataFrame, by: list[str], features: list[str], ridge: float) -> DataFrame:
    """Pooled feature mean and sample covariance (plus ridge) of several error features."""
    means = [F.avg(f).alias(f"mu_{f}") for f in features]
    pairs = [
        (F.covar_samp(a, b) + F.lit(ridge if i == j else 0.0)).alias(f"cov_{a}_{b}")
        for i, a in enumerate(features)
        for j, b in enumerate(features)
        if i <= j
    ]
    return rows.groupBy(*by).agg(*means, *pairs)


def feature_inverse(params: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """Rows of parameters to ``mu`` and inverse covariance arrays, m by m per model."""
    m = len(features)
    names = [f"mu_{f}" for f in features]
    cells = [[f"cov_{features[min(i, j)]}_{features[max(i, j)]}" for j in range(m)] for i in range(m)]
    schema = ", ".join([*[f"{c} {params.schema[c].dataType.simpleString()}" for c in by], "mu array<double>", "inverse array<array<double>>"])

    def invert(batches):
        for pdf in batches:
            out = pdf[by].copy()
            out["mu"] = pdf[names].to_numpy().tolist()
            stack = np.stack([[pdf[c].to_numpy() for c in row] for row in cells]).transpose(2, 0, 1)
            inverse = []
            for cov in stack:
                try:
                    inverse.append(np.linalg.inv(cov).tolist())
                except np.linalg.LinAlgError:
                    inverse.append(np.linalg.pinv(cov).tolist())
            out["inverse"] = inverse
            yield out

    return params.mapInPandas(invert, schema)


def quadratic_form(d: Column, inverse: Column) -> Column:
    """``d' A d`` for a small dense A."""
    return dot(F.transform(inverse, lambda row: dot(row, d)), d)


def window_fit(errors: DataFrame, by: list[str], ridge: float) -> DataFrame:
    """Window-level error distribution in factor form.

    For sample covariance S of n fit windows, (S + ridge I)^-1 equals
    (I - B'B) / ridge with at most n - 1 rows in B. The group is the fit split of
    one model: a bounded number of windows by the split rule. For a global model
    over many series use ``pooled_window_fit``.
    """
    schema = ", ".join(
        [*[f"{c} {errors.schema[c].dataType.simpleString()}" for c in by], "mu array<double>", "basis array<array<double>>", "n_fit long"]
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["series_id", "window_id"])
        x = np.stack(ordered["err"].to_numpy())
        if len(x) < 2:
            if by:  # this model stays without window parameters; the others go on
                return pd.DataFrame(columns=names)
            raise ValueError("window scoring needs at least two fit windows per model")
        mu = x.mean(axis=0)
        _, s, vt = np.linalg.svd(x - mu, full_matrices=False)
        keep = s > s[0] * 1e-12
        shrink = s[keep] / np.sqrt((len(x) - 1) * ridge + s[keep] ** 2)
        row = {c: pdf[c].iloc[0] for c in by}
        row.update(mu=mu.tolist(), basis=(vt[keep] * shrink[:, None]).tolist(), n_fit=len(x))
        return pd.DataFrame([row])

    names = [*by, "mu", "basis", "n_fit"]
    need = list(dict.fromkeys([*by, "series_id", "window_id", "err"]))
    return errors.select(*need).groupBy(*by).applyInPandas(fit, schema)


def pooled_window_fit(errors: DataFrame, length: int, ridge: float) -> DataFrame:
    """The same parameters for one global model over any number of fit windows.

    Every task reduces its windows to a count, a sum and a Gram matrix around a
    common pivot; these add up on Spark, and only the L by L result (bounded by
    the window length) is factored in a single row.
    """
    pivot = errors.select(F.posexplode("err").alias("pos", "_e")).groupBy("pos").agg(F.avg("_e").alias("m"), F.count("_e").alias("n"))
    mean_row = pivot.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mu"), F.max("n").alias("n_fit")
    )
    centred = attach(errors.select("err"), mean_row, [])

    def gram(batches):
        total = np.zeros((length, length))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["err"].to_numpy()) - np.asarray(pdf["mu"].iloc[0])
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(length), "g": list(total)})

    parts = centred.select("err", "mu").mapInPandas(gram, "i int, g array<double>")
    cells = parts.select("i", F.posexplode("g").alias("j", "_g")).groupBy("i", "j").agg(F.sum("_g").alias("g"))
    rows = cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "g"))), lambda x: x["g"]).alias("g"))
    square = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda x: x["g"]).alias("gram"))
    whole = attach(square, mean_row, [])

    def factor(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                g = np.stack([np.asarray(r) for r in row["gram"]])
                n = int(row["n_fit"])
                if n < 2:
                    raise ValueError("window scoring needs at least two fit windows")
                lam, v = np.linalg.eigh((g + g.T) / 2)
                keep = lam > lam.max() * 1e-14
                shrink = np.sqrt(lam[keep] / ((n - 1) * ridge + lam[keep]))
                out.append({"mu": list(row["mu"]), "basis": (v[:, keep] * shrink).T.tolist(), "n_fit": n})
            yield pd.DataFrame(out)

    return whole.select("mu", "n_fit", "gram").mapInPandas(factor, "mu array<double>, basis array<array<double>>, n_fit long")


# Keys whose Gram sums a task holds, and groups in which the partial sums of a key are added up before the last step.
KEYS_HELD = 64
PARTIALS = 64


def keyed_gram(errors: DataFrame, by: list[str], length: int) -> DataFrame:
    """``by, mu, gram, n_fit``: mean, packed upper triangle of the centred Gram matrix, and number of windows per key.

    For keys of any size: every task reduces its windows to one partial triangle per key (at most ``KEYS_HELD`` are held), the
    partials of a key are added in ``PARTIALS`` groups and then together, so no group holds windows.
    """
    kinds = "".join(f"`{c}` {errors.schema[c].dataType.simpleString()}, " for c in by)
    each = errors.select(*by, F.posexplode("err").alias("pos", "_e")).groupBy(*by, "pos").agg(F.avg("_e").alias("m"), F.count("_e").alias("n"))
    means = settle(
        each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mu"), F.max("n").alias("n_fit"))
    )
    rows, cols = np.triu_indices(length)

    def partial(batches):
        held: dict = {}

        def rows_of(sums):
            frame = pd.DataFrame(list(sums), columns=by)
            return frame.assign(gram=[g[rows, cols] for g in sums.values()])

        for pdf in batches:
            for key, part in pdf.groupby(by, dropna=False, sort=False):
                x = np.stack(part["err"].to_numpy()) - np.asarray(part["mu"].iloc[0])
                held[key] = held.get(key, 0.0) + x.T @ x
                if len(held) > KEYS_HELD:
                    yield rows_of(held)
                    held = {}
        if held:
            yield rows_of(held)

    def added(pdf):
        return pdf.iloc[:1][by].assign(gram=[np.sum(np.stack(pdf["gram"].to_numpy()), axis=0)])

    parts = attach(errors.select(*by, "err"), means, by).select(*by, "err", "mu").mapInPandas(partial, kinds + "gram array<double>")
    dealt = parts.withColumn("_salt", F.spark_partition_id() % PARTIALS)
    once = dealt.groupBy(*by, "_salt").applyInPandas(lambda pdf: added(pdf), kinds + "gram array<double>")
    whole = once.groupBy(*by).applyInPandas(lambda pdf: added(pdf), kinds + "gram array<double>")
    return attach(whole, means, by).select(*by, "mu", "gram", "n_fit")


def keyed_window_fit(errors: DataFrame, by: list[str], length: int, ridge: float) -> DataFrame:
    """The parameters of ``window_fit`` for any key list, from Gram sums; a key with a single window has none."""
    kinds = "".join(f"`{c}` {errors.schema[c].dataType.simpleString()}, " for c in by)
    rows, cols = np.triu_indices(length)

    def factor(batches):
        for pdf in batches:
            basis = []
            for packed, n in zip(pdf["gram"], pdf["n_fit"]):
                g = np.zeros((length, length))
                g[rows, cols] = g[cols, rows] = packed
                lam, v = np.linalg.eigh(g)
                keep = lam > lam.max() * 1e-14
                basis.append((v[:, keep] * np.sqrt(lam[keep] / ((n - 1) * ridge + lam[keep]))).T.tolist())
            yield pdf[[*by, "mu"]].assign(basis=basis, n_fit=pdf["n_fit"])

    return keyed_gram(errors, by, length).filter("n_fit > 1").mapInPandas(factor, kinds + "mu array<double>, basis array<array<double>>, n_fit long")


# The explicit covariance has L (L + 1) / 2 aggregates: 528 at this length.
LONGEST_EXPLICIT = 32


def position_covariance(errors: DataFrame, by: list[str], length: int, ridge: float) -> DataFrame:
    """Explicit position covariance for short windows: one pass, no self join.

    ``i, j, cov`` in long form, i <= j. Windows above ``LONGEST_EXPLICIT`` use the factor form instead.
    """
    if length > LONGEST_EXPLICIT:
        raise ValueError(f"windows of more than {LONGEST_EXPLICIT} points take window_fit")
    pairs = [(i, j) for i in range(length) for j in range(i, length)]
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(j).alias("j"),
                (F.covar_samp(F.get("err", F.lit(i)), F.get("err", F.lit(j))) + F.lit(ridge if i == j else 0.0)).alias("cov"),
            )
            for i, j in pairs
        ]
    )
    return errors.groupBy(*by).agg(cells.alias("_cells")).select(*by, F.inline("_cells"))


def point_scores(errors: DataFrame) -> DataFrame:
    """Squared deviation over variance for every point; the window takes the maximum."""
    scored = errors.withColumn("point_scores", F.transform("err", lambda e: F.pow(e - F.col("mu_point"), 2) / F.col("var_point")))
    return scored.withColumn("window_score", F.array_max("point_scores"))


def window_scores(errors: DataFrame, ridge: float) -> DataFrame:
    """Quadratic form of the centred error vector (no square root), in factor form."""
    centred = errors.withColumn("_d", F.zip_with("err", "mu", lambda a, b: a - b))
    explained = F.aggregate("basis", F.lit(0.0), lambda s, b: s + F.pow(dot(b, F.col("_d")), 2))
    return centred.withColumn("window_score", (dot(F.col("_d"), F.col("_d")) - explained) / F.lit(ridge)).drop("_d")


def hard_flag(tau: Column, k: int) -> Column:
    """At least ``k`` points strictly above ``tau``."""
    return F.size(F.filter("point_scores", lambda s: s > tau)) >= k


def threshold_fit(scores: DataFrame, by: list[str], value: str, spec: ScorerSpec, bounded: bool = True) -> DataFrame:
    """Percentile or sigma threshold per model.

    ``bounded`` says that one model's pool is limited (its threshold split);
    an unlimited pool takes the sketch-bracketed exact percentile.
    """
    if spec.threshold_method == "sigma":
        return scores.groupBy(*by).agg((F.avg(value) + F.lit(spec.sigma) * F.stddev_pop(value)).alias("threshold"))
    if bounded:
        return scores.groupBy(*by).agg(F.percentile(value, F.lit(spec.percentile / 100.0)).alias("threshold"))
    return exact_percentiles(scores, by, value, [spec.percentile / 100.0]).select(*by, "threshold")
