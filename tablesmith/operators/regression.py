"""Linear models.

All fits read cross-product sums, which one pass over the data yields, for all folds of a search at
once; what reaches the driver is p x p numbers. A fitted model is a pipeline of SQL stages: it can be
saved, applies to batches and streams alike, and scoring stays in generated code (no vectors, no UDF).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesmith.operators.features import Scaler, fit_scaler, fold_column, split_column
from tablesmith.operators.quality import validate_training
from tablesmith.schema import require_columns

# The documented search grids.
GRIDS = {
    "linear": {},
    "ridge": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "lasso": {"alpha": [0.01, 0.1, 1.0, 10.0]},
    "elastic_net": {"alpha": [0.01, 0.1, 1.0], "l1_ratio": [0.1, 0.5, 0.7, 0.9]},
}


@dataclass
class RegressionConfig:
    kind: str = "linear"            # linear, ridge, lasso, elastic_net
    alpha: float = 1.0
    l1_ratio: float = 0.5
    scaling: str | None = None      # standard, minmax, robust or None

    def __post_init__(self):
        if self.kind not in GRIDS:
            raise ValueError(f"unknown model type: {self.kind}")

    def penalties(self) -> tuple[float, float]:
        """L1 and L2 weights of ||y - Xw||^2 / (2n) + l1 |w| + l2 |w|^2 / 2; ridge's L2 is per row."""
        if self.kind == "lasso":
            return self.alpha, 0.0
        if self.kind == "elastic_net":
            return self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio)
        return 0.0, 0.0


# --- cross-product sums -----------------------------------------------------------------------


@dataclass
class Moments:
    """Row count, sums and cross products of some columns, measured from a common centre."""

    n: float
    sums: np.ndarray
    cross: np.ndarray
    centre: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.sums - other.sums, self.cross - other.cross, self.centre)

    def covariance(self) -> np.ndarray:
        return self.cross / self.n - np.outer(self.sums, self.sums) / self.n**2

    def means(self) -> np.ndarray:
        return self.centre + self.sums / self.n


def _number(c: str) -> Column:
    """The column as a double, NaN as NULL."""
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def moments(df: DataFrame, cols: Sequence[str], by: Column | None = None, direct: int = 12, learn=None) -> dict:
    """Moments of all rows with a target (the last of ``cols``), per value of ``by`` (folds or train/test: a handful).

    A missing feature counts as its column's mean over all rows with a target, or over those whose ``by`` is
    ``learn``. Everything is measured from these means, so a missing value just adds nothing to sums and products.
    """
    names, cols = list(cols), [f"c{i}" for i in range(len(cols))]
    values = df.select((F.lit(0) if by is None else by).alias("_by"), *[_number(c).alias(n) for n, c in zip(cols, names)]).where(F.col(cols[-1]).isNotNull())
    known = values if learn is None else values.where(F.col("_by") == learn)
    first = known.agg(*[F.avg(c) for c in cols]).first()
    centre = np.array([v or 0.0 for v in first], dtype=float)
    k = len(cols)
    if k <= direct:
        dev = [F.coalesce(F.col(c) - F.lit(float(m)), F.lit(0.0)) for c, m in zip(cols, centre)]
        upper = [(i, j) for i in range(k) for j in range(i, k)]
        rows = values.groupBy("_by").agg(
            F.count("*").alias("n"), *[F.sum(d).alias(f"s{i}") for i, d in enumerate(dev)],
            *[F.sum(dev[i] * dev[j]).alias(f"x{i}_{j}") for i, j in upper]).collect()
        return {r["_by"]: Moments(
            float(r["n"]), np.array([r[f"s{i}"] for i in range(k)]),
            np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]), centre) for r in rows}

    key_type = values.schema["_by"].dataType.simpleString()

    def task(batches):
        acc: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby("_by"):
                x = np.nan_to_num(part[cols].to_numpy(dtype=float) - centre, nan=0.0)
                x = np.column_stack([np.ones(len(x)), x])
                acc[key] = acc.get(key, 0.0) + x.T @ x
        for key, g in acc.items():
            i, j = np.divmod(np.arange((k + 1) ** 2), k + 1)
            yield pd.DataFrame({"_by": key, "i": i, "j": j, "v": g.ravel()})

    parts = values.mapInPandas(task, f"_by {key_type}, i long, j long, v double")
    grams: dict = {}
    for r in parts.groupBy("_by", "i", "j").agg(F.sum("v").alias("v")).collect():
        grams.setdefault(r["_by"], np.zeros((k + 1, k + 1)))[r["i"], r["j"]] = r["v"]
    return {key: Moments(g[0, 0], g[0, 1:], g[1:, 1:], centre) for key, g in grams.items()}


def total(parts: dict) -> Moments:
    ms = list(parts.values())
    return Moments(sum(m.n for m in ms), sum(m.sums for m in ms), sum(m.cross for m in ms), ms[0].centre)


def solve(m: Moments, config: RegressionConfig) -> tuple[np.ndarray, float]:
    """Coefficients and intercept; the last column of the moments is the target."""
    cov = m.covariance()
    a, b = cov[:-1, :-1], cov[:-1, -1]
    l1, l2 = config.penalties()
    if config.kind == "ridge":
        l2 = config.alpha / m.n
    a = a + l2 * np.eye(len(a))
    if l1 == 0.0:
        w = np.linalg.lstsq(a, b, rcond=None)[0]
    else:
        # Coordinate descent on the p x p matrix.
        w = np.zeros(len(b))
        for _ in range(10_000):
            before = w.copy()
            for j in np.flatnonzero(np.diag(a) > 0):
                rest = b[j] - a[j] @ w + a[j, j] * w[j]
                w[j] = np.sign(rest) * max(abs(rest) - l1, 0.0) / a[j, j]
            if np.max(np.abs(w - before)) <= 1e-12 * max(1.0, np.max(np.abs(w))):
                break
    means = m.means()
    return w, float(means[-1] - w @ means[:-1])


def r2_score(m: Moments, w: np.ndarray, intercept: float) -> float | None:
    cov, means = m.covariance(), m.means()
    bias = means[-1] - intercept - w @ means[:-1]
    mse = cov[-1, -1] - 2 * w @ cov[:-1, -1] + w @ cov[:-1, :-1] @ w + bias**2
    return None if cov[-1, -1] <= 0 else float(1 - mse / cov[-1, -1])


def _scaled(m: Moments, spread: np.ndarray) -> Moments:
    d = np.append(1.0 / np.where(spread > 0, spread, 1.0), 1.0)
    return Moments(m.n, m.sums * d, m.cross * np.outer(d, d), m.centre * d)


# --- fitting and applying ---------------------------------------------------------------------


@dataclass
class FittedRegression:
    model: PipelineModel
    target: str
    features: list[str]
    config: RegressionConfig
    n_train: int
    coefficients: list[float]
    intercept: float

    def predict(self, df: DataFrame, mode: str = "fitted") -> DataFrame:
        return predict(self.model, df, self.features, mode)


def fit(df: DataFrame, target: str, features: Sequence[str], config: RegressionConfig | None = None) -> FittedRegression:
    """Train on the rows with a target. Missing features get the training mean."""
    config, features = config or RegressionConfig(), list(features)
    validate_training(df, target, features)
    rows = df.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    stats = rows.agg(*[F.avg(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))).alias(f) for f in features]).first()
    means = {f: float(stats[f] or 0.0) for f in features}
    filled = rows.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(means[f])) for f in features})
    scaler = fit_scaler(filled, features, config.scaling) if config.scaling else Scaler({f: 0.0 for f in features}, {f: 1.0 for f in features})

    def prepared(f: str) -> str:
        value = f"coalesce(nanvl(CAST(`{f}` AS DOUBLE), CAST(NULL AS DOUBLE)), {means[f]!r}D)"
        return f"({value} - ({scaler.centre[f]!r}D)) / ({scaler.spread[f]!r}D)"

    names = [f"_x_{i}" for i in range(len(features))]
    cols = ", ".join(f"{prepared(f)} AS `{n}`" for f, n in zip(features, names))
    prepare = SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__")
    m = moments(prepare.transform(rows), [*names, target])[0]
    w, intercept = solve(m, config)
    terms = " + ".join(f"({float(c)!r}D) * `{n}`" for c, n in zip(w, names))
    score = SQLTransformer(statement=f"SELECT *, ({intercept!r}D) + {terms} AS prediction FROM __THIS__")
    return FittedRegression(PipelineModel([prepare, score]), target, features, config, int(m.n), [float(c) for c in w], intercept)


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], mode: str = "fitted") -> DataFrame:
    """Score every row. Missing features get the fitted means, or 0 with ``mode='zero'``."""
    require_columns(df, list(features))
    if mode == "zero":
        from tablesmith.functions.formats import fill_scoring
        df = df.withColumns({f: fill_scoring(f) for f in features})
    out = model.transform(df)
    return out.drop(*[c for c in out.columns if c.startswith("_x_")])


def predict_many(model: PipelineModel, tables: dict[str, DataFrame], features: Sequence[str]) -> tuple[DataFrame | None, DataFrame]:
    """Score several tables; returns all predictions with ``dataset_id``, and one status row per table."""
    scored, status, spark = None, [], None
    for name, df in tables.items():
        spark = df.sparkSession
        try:
            part = predict(model, df, features).select(F.lit(name).alias("dataset_id"), *features, "prediction")
        except ValueError as e:
            status.append((name, "error", str(e)))
            continue
        status.append((name, "success", None))
        scored = part if scored is None else scored.unionByName(part)
    return scored, spark.createDataFrame(status, "dataset_id string, status string, error string")


def coefficient_table(df: DataFrame, features: Sequence[str], coefs: Sequence[float], intercept: float) -> DataFrame:
    rows = [("(intercept)", float(intercept)), *[(f, float(c)) for f, c in zip(features, coefs)]]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def feature_importance(coefs: DataFrame) -> DataFrame:
    """Share of each absolute coefficient; all zero stays zero. The table has one row per feature."""
    features = coefs.where("feature <> '(intercept)'")
    whole = features.agg(F.sum(F.abs("coefficient"))).scalar()
    return features.select(
        "feature", F.round(F.coalesce(F.try_divide(F.abs("coefficient"), whole), F.lit(0.0)), 4).alias("importance"))


# --- measuring --------------------------------------------------------------------------------


def regression_metrics(df: DataFrame, actual: str, predicted: str, n_train: int | None = None, p: int | None = None) -> DataFrame:
    y, e = F.col(actual).cast("double"), F.col(actual).cast("double") - F.col(predicted)
    one = df.agg(
        F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_vy"),
        F.var_pop(e).alias("_ve"), F.avg(F.when(y != 0, F.abs(F.try_divide(e, y)))).alias("mape"))
    r2 = F.lit(1.0) - F.try_divide(F.col("mse"), F.col("_vy"))
    adjusted = F.lit(None).cast("double")
    if n_train is not None and p is not None and n_train - p - 1 > 0:
        adjusted = F.lit(1.0) - (F.lit(1.0) - r2) * F.lit((n_train - 1) / (n_train - p - 1))
    return one.select(
        "n", F.round(r2, 4).alias("r2"), F.round(adjusted, 4).alias("adjusted_r2"), F.round("mse", 4).alias("mse"),
        F.round("mae", 4).alias("mae"), F.round(F.sqrt("mse"), 4).alias("rmse"), F.round("mape", 4).alias("mape"),
        F.round(F.lit(1.0) - F.try_divide(F.col("_ve"), F.col("_vy")), 4).alias("explained_variance"))


def residual_diagnostics(df: DataFrame, residual: str = "residual") -> DataFrame:
    """Mean, deviation, skew, kurtosis and the Jarque-Bera normality test (chi-square with 2 degrees)."""
    one = df.agg(
        F.count(residual).alias("n"), F.avg(residual).alias("mean"), F.stddev_samp(residual).alias("std"),
        F.skewness(residual).alias("skewness"), F.kurtosis(residual).alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4.0)
    return one.withColumn("jarque_bera", jb).withColumn("p_value", F.exp(-F.col("jarque_bera") / 2.0)).withColumn(
        "looks_normal", F.col("p_value") > 0.05)


def cross_validate(df: DataFrame, target: str, features: Sequence[str], key: str, folds: int = 5, seed: int = 42,
                   config: RegressionConfig | None = None) -> DataFrame:
    """R2 of each held-out fold, with mean and population deviation; plain least squares by default.

    All rows with a target take part; missing features count as their means, as in ``fit``.
    """
    parts = moments(df, [*features, target], fold_column(key, folds, seed))
    whole = total(parts)
    scores = []
    for fold in sorted(parts):
        w, b = solve(whole - parts[fold], config or RegressionConfig())
        scores.append(r2_score(parts[fold], w, b))
    known = [s for s in scores if s is not None]
    mean, std = (float(np.mean(known)), float(np.std(known))) if known else (None, None)
    return df.sparkSession.createDataFrame(
        [(f, s, mean, std) for f, s in zip(sorted(parts), scores)], "fold int, r2 double, cv_mean double, cv_std double")


def grid_search(df: DataFrame, target: str, features: Sequence[str], kind: str, key: str, folds: int = 5, seed: int = 42,
                scaling: str | None = None, grid: dict[str, list[float]] | None = None) -> DataFrame:
    """Mean held-out R2 of every grid point; one pass over the data serves the whole grid."""
    parts = moments(df, [*features, target], fold_column(key, folds, seed))
    if scaling == "standard":
        spread = np.sqrt(np.diag(total(parts).covariance()))[:-1]
        parts = {f: _scaled(m, spread) for f, m in parts.items()}
    whole = total(parts)
    grid = GRIDS[kind] if grid is None else grid
    rows = []
    for point in product(*grid.values()):
        config = RegressionConfig(kind, **dict(zip(grid, point)))
        scores = [r2_score(m, *solve(whole - m, config)) for _, m in sorted(parts.items())]
        rows.append((config.alpha if grid else None, config.l1_ratio if kind == "elastic_net" else None, float(np.mean(scores))))
    best = max(range(len(rows)), key=lambda i: rows[i][2])
    return df.sparkSession.createDataFrame(
        [(*r, i == best) for i, r in enumerate(rows)], "alpha double, l1_ratio double, mean_r2 double, best boolean")


def select_rfe(df: DataFrame, features: Sequence[str], target: str, k: int = 10) -> DataFrame:
    """Drop the feature with the smallest absolute coefficient until ``k`` are left; kept ones rank 1."""
    features = list(features)
    m = moments(df, [*features, target])[0]
    cov = m.covariance()
    kept, rank = list(range(len(features))), {}
    while len(kept) > k:
        w = np.linalg.lstsq(cov[np.ix_(kept, kept)], cov[kept, -1], rcond=None)[0]
        worst = kept[int(np.argmin(np.abs(w)))]
        kept.remove(worst)
        rank[worst] = len(kept) - k + 2
    return df.sparkSession.createDataFrame(
        [(f, rank.get(i, 1), i in kept) for i, f in enumerate(features)], "feature string, rank int, selected boolean")


def compare_models(df: DataFrame, target: str, features: Sequence[str], configs: dict[str, RegressionConfig], key: str,
                   test: float = 0.2, seed: int = 42) -> DataFrame:
    """Train and test quality of several models: one pass fits them all, a second one measures them.

    All rows with a target take part, missing features count as their training means. ``scaling`` of a config is
    standard, minmax, robust or none; the scaler learns from training rows. ``best`` marks the highest test R2, the first
    by name among equals.
    """
    features = list(features)
    side = split_column(key, test, seed)
    train = moments(df, [*features, target], side, learn="train")["train"]
    means = dict(zip(features, train.centre))
    filled = df.select(side.alias("_side"), _number(target).alias("_y"), *[F.coalesce(_number(f), F.lit(float(means[f]))).alias(f"_f{i}") for i, f in enumerate(features)])
    filled = filled.where("_y IS NOT NULL")
    spreads: dict[str, np.ndarray] = {"standard": np.sqrt(np.maximum(np.diag(train.covariance()), 0.0))[:-1]}
    fitted = {}
    for name, config in configs.items():
        if config.scaling is None:
            fitted[name] = solve(train, config)
            continue
        if config.scaling not in spreads:
            scaler = fit_scaler(filled.where("_side = 'train'"), [f"_f{i}" for i in range(len(features))], config.scaling)
            spreads[config.scaling] = np.array([scaler.spread.get(f"_f{i}", 1.0) for i in range(len(features))])
        spread = spreads[config.scaling]
        w, b = solve(_scaled(train, spread), config)
        fitted[name] = (w / np.where(spread > 0, spread, 1.0), b)

    def error(w, b) -> Column:
        out = F.col("_y") - F.lit(float(b))
        for i, c in enumerate(w):
            out = out - F.lit(float(c)) * F.col(f"_f{i}")
        return out

    names = list(fitted)
    measured = filled.groupBy("_side").agg(
        F.var_pop("_y").alias("_v"), *[e for i, n in enumerate(names) for e in (
            F.avg(error(*fitted[n]) ** 2).alias(f"mse{i}"), F.avg(F.abs(error(*fitted[n]))).alias(f"mae{i}"))])
    cells = F.array(*[F.struct(
        F.lit(n).alias("model"), F.col(f"mse{i}").alias("mse"), F.col(f"mae{i}").alias("mae")) for i, n in enumerate(names)])
    tidy = measured.select("_side", "_v", F.explode(cells).alias("_x")).select("_side", "_v", "_x.*")
    on = lambda s, c: F.max(F.when(F.col("_side") == s, c))
    r2 = F.lit(1.0) - F.try_divide(F.col("mse"), F.col("_v"))
    wide = tidy.groupBy("model").agg(
        on("train", r2).alias("train_r2"), on("test", r2).alias("test_r2"), on("train", F.col("mse")).alias("train_mse"),
        on("test", F.col("mse")).alias("test_mse"), on("test", F.col("mae")).alias("test_mae"))
    gap = F.col("train_r2") - F.col("test_r2")
    top = Window.orderBy(F.desc_nulls_last("test_r2"), "model")  # one row per model
    return wide.withColumn("overfit_gap", gap).withColumn("overfits", F.abs(gap) > 0.1).withColumn("best", F.row_number().over(top) == 1)


def best_model(df: DataFrame, metric: str = "test_r2", name: str = "model") -> DataFrame:
    """The row with the largest metric, the first by name among equals."""
    return df.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), name).limit(1)
