"""Pearson correlation on pairwise complete rows, and what is read from it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.schema import nan_to_null, numeric_columns


def safe_corr(a: Column, b: Column) -> Column:
    """Correlation aggregate that gives NULL, not an error, for constant or empty input."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0)))


def _pair_moments(df: DataFrame, cols: list[str], centre: list[float]) -> DataFrame:
    """Per pair of columns: n, sums and products over rows where both are present.

    Each task adds up small matrices over its Arrow batches and emits one row per pair, so the
    shuffle carries k*k rows per task whatever the number of input rows.
    """
    k = len(cols)

    def task(batches):
        n, sx, sxx, sxy = (np.zeros((k, k)) for _ in range(4))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - np.asarray(centre)
            seen = ~np.isnan(x)
            x, m = np.where(seen, x, 0.0), seen.astype(float)
            n += m.T @ m
            sx += x.T @ m
            sxx += (x * x).T @ m
            sxy += x.T @ x
        i, j = np.divmod(np.arange(k * k), k)
        yield pd.DataFrame({
            "i": i.astype("int32"), "j": j.astype("int32"), "n": n.ravel(), "sa": sx.ravel(),
            "sb": sx.T.ravel(), "saa": sxx.ravel(), "sbb": sxx.T.ravel(), "sab": sxy.ravel()})

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(
        task, "i int, j int, n double, sa double, sb double, saa double, sbb double, sab double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, max_cols: int | None = None, direct: int = 4) -> DataFrame:
    """All ordered pairs ``col_a, col_b, r``; r is NULL where it is undefined.

    Up to ``direct`` columns are one SQL aggregate; more would outgrow generated code, so they are
    summed as small matrices in Arrow batches.
    """
    cols, df = list(cols or numeric_columns(df))[:max_cols], nan_to_null(df)
    if len(cols) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    if len(cols) <= direct:
        pairs = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
        wide = df.agg(*[safe_corr(F.col(cols[a]), F.col(cols[b])).alias(f"r_{a}_{b}") for a, b in pairs])
        cell = F.array(*[
            F.struct(F.lit(cols[a]).alias("col_a"), F.lit(cols[b]).alias("col_b"),
                     F.col(f"r_{min(a, b)}_{max(a, b)}").alias("r"))
            for a in range(len(cols)) for b in range(len(cols))])
        return wide.select(F.explode(cell).alias("_x")).select("_x.*")
    means = df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in cols]).first()
    m = _pair_moments(df, cols, [float(v) for v in means])
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    va = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    spread = F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0)))
    names = F.array(*[F.lit(c) for c in cols])
    return m.select(
        F.element_at(names, F.col("i") + 1).alias("col_a"), F.element_at(names, F.col("j") + 1).alias("col_b"),
        F.when(F.col("n") > 1, F.try_divide(cov, F.nullif(spread, F.lit(0.0)))).alias("r"))


def _unordered(pairs: DataFrame, cols: Sequence[str]) -> DataFrame:
    place = F.array(*[F.lit(c) for c in cols])
    return pairs.where(F.array_position(place, F.col("col_a")) < F.array_position(place, F.col("col_b")))


def strong_correlations(df: DataFrame, cols: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """The ``k`` strongest pairs by absolute value, each pair once; perfect ones are left out."""
    cols = list(cols or numeric_columns(df))
    pairs = _unordered(correlation_matrix(df, cols), cols).withColumn("abs_r", F.abs("r")).where("abs_r < 1.0")
    return pairs.orderBy(F.desc("abs_r"), "col_a", "col_b").limit(k)


def multicollinear_pairs(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.8) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return _unordered(correlation_matrix(df, cols), cols).where(F.abs("r") > threshold)


def select_kbest(df: DataFrame, features: Sequence[str], target: str, k: int = 10) -> DataFrame:
    """The ``k`` features with the largest regression F statistic, over all rows with a target.

    Missing features (NULL or NaN) count as their mean over these rows. They then add nothing to covariances, so one pass
    of sums over the rows that have them is enough.
    """
    features, y = list(features), F.col(target).cast("double")
    rows = nan_to_null(df).where(F.col(target).isNotNull())
    sums = []
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        there = F.when(x.isNotNull(), y)
        # With gaps at the mean: the sum of (x - mean) * y over the rows that have x.
        cov = F.count(x) * F.covar_pop(x, there)
        spread = F.sqrt(F.var_pop(x) * F.count(x) * F.var_pop(y) * F.count(y))
        sums += [F.try_divide(cov, F.nullif(spread, F.lit(0.0))).alias(f"r_{i}"), F.count(y).alias(f"n_{i}")]
    wide = rows.agg(*sums)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"r_{i}").alias("r"), F.col(f"n_{i}").alias("n"))
                      for i, f in enumerate(features)])
    r2 = F.col("r") * F.col("r")
    scored = wide.select(F.explode(cells).alias("_x")).select("_x.*").withColumn(
        "f_score", F.when(r2 >= 1.0, F.lit(float("inf"))).otherwise(F.try_divide(r2 * (F.col("n") - 2), F.lit(1.0) - r2)))
    return scored.orderBy(F.desc_nulls_last("f_score"), "feature").limit(k).select("feature", "r", "f_score")

