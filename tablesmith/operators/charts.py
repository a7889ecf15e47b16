"""The numbers behind charts: histograms, boxes, densities, lines, samples."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.operators.ordering import running, trailing, with_position
from tablesmith.operators.quantiles import exact_quantiles
from tablesmith.schema import nan_to_null
from tablesmith.session import settle


def histogram(df: DataFrame, col: str, bins: int = 30, density: bool = False, by: str | None = None) -> DataFrame:
    """Equal-width bins between minimum and maximum; every bin is listed, also the empty ones.

    With ``by`` each group gets its own range. The last bin includes its right edge. NaN is missing.
    """
    keys, df = [by] if by else [], nan_to_null(df)
    data = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("_v"))
    if by:
        data = data.where(F.col(by).isNotNull())
        ranges, few = settle(data.groupBy(by).agg(
            F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
        placed = data.join(F.broadcast(ranges) if few else ranges, by)
    else:
        n, lo, hi = data.agg(F.count("*"), F.min("_v"), F.max("_v")).first()
        ranges = df.sparkSession.createDataFrame([(n, lo, hi)] if n else [], "_n long, _lo double, _hi double")
        few = True
        placed = data.withColumns({"_n": F.lit(n), "_lo": F.lit(lo).cast("double"), "_hi": F.lit(hi).cast("double")})
    width = (F.col("_hi") - F.col("_lo")) / bins
    # A constant column falls into the first bin.
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), width), F.lit(0.0))), F.lit(bins - 1))
    counts = placed.groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    full = ranges.select(*keys, "_n", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = full.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin",
        (F.col("_lo") + width * F.col("bin")).alias("left_edge"),
        (F.col("_lo") + width * (F.col("bin") + 1)).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"), "_n", width.alias("_w"))
    if density:
        out = out.withColumn("density", F.try_divide(F.col("n"), F.col("_n") * F.col("_w")))
    return out.drop("_n", "_w")


def box_stats(df: DataFrame, col: str, by: str | None = None, k: float = 1.5, **kw) -> DataFrame:
    """Five numbers, whiskers (most extreme values inside the fences) and outlier count. NaN is missing."""
    keys, df = [by] if by else [], nan_to_null(df)
    q = exact_quantiles(df, [col], [0.25, 0.5, 0.75], by=keys, **kw).select(
        *keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    fences, few = settle(q)
    lo, hi = (F.col("q1") - k * (F.col("q3") - F.col("q1"))), (F.col("q3") + k * (F.col("q3") - F.col("q1")))
    data = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("_v"))
    if by:
        joined = data.join(F.broadcast(fences) if few else fences, by)
    else:
        one = fences.first()
        joined = data.withColumns({n: F.lit(one[n] if one else None).cast("double") for n in ("q1", "median", "q3")})
    within = F.col("_v").between(lo, hi)
    return joined.groupBy(*keys, "q1", "median", "q3").agg(
        F.count("*").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.min(F.when(within, F.col("_v"))).alias("whisker_low"), F.max(F.when(within, F.col("_v"))).alias("whisker_high"),
        F.count_if(~within).alias("n_outliers"))


#: Bins for each bandwidth, moments kept of a bin, and bandwidths beyond which a kernel is nothing.
BINS, MOMENTS, REACH = 8, 8, 9.0


def _hermite() -> list[list[float]]:
    """Coefficients, by rising power, of the polynomials He_k(z) / k! for k below ``MOMENTS``."""
    he = [[1.0], [0.0, 1.0]]
    for k in range(1, MOMENTS - 1):
        up = [0.0, *he[k]]
        he.append([c - k * (he[k - 1][j] if j < len(he[k - 1]) else 0.0) for j, c in enumerate(up)])
    return [[c / math.factorial(k) for c in p] for k, p in enumerate(he)]


def kde(df: DataFrame, col: str, points: int = 100, by: str | None = None) -> DataFrame:
    """Gaussian density on an even grid from minimum to maximum, Scott bandwidth.

    One pass finds each group's range and bandwidth h. A second adds up, in bins of h / 8, the powers of the values'
    distances t to the middle of their bin, in bandwidths. A bin's kernels at a grid point at distance z are the sum over k of
    He_k(z) / k! times the k-th power sum, times exp(-z*z/2); with eight power sums and abs(t) up to 1/16 the rest is
    below 2e-12 of a kernel's height. What is shuffled is eight sums per bin, whatever the number of rows, and a bin
    goes only to grid points within nine bandwidths, beyond which a kernel is below 1e-17. NaN counts as missing.
    """
    keys = [by] if by else []
    value = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    data = df.select(*keys, value.alias("_v")).where("_v IS NOT NULL")
    if by:
        data = data.where(F.col(by).isNotNull())
    shape = data.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.stddev_samp("_v").alias("_s"))
    shape = shape.where((F.col("_n") > 1) & (F.col("_s") > 0)).withColumn("_h", F.col("_s") * F.pow("_n", F.lit(-0.2)))
    shape, few = settle(shape)
    if by:
        rows = data.join(F.broadcast(shape) if few else shape, by)
    else:
        one = shape.first()
        if one is None:
            return df.sparkSession.createDataFrame([], "point int, x double, density double")
        rows = data.withColumns({c: F.lit(one[c]) for c in ("_n", "_lo", "_hi", "_h")})
    place = (F.col("_v") - F.col("_lo")) / F.col("_h")
    bin_ = F.floor(place * BINS)
    t = place - (bin_ + 0.5) / BINS
    facts = ["_n", "_lo", "_hi", "_h"]
    bins = rows.groupBy(*keys, *facts, bin_.alias("_bin")).agg(*[F.sum(F.pow(t, F.lit(float(k)))).alias(f"_m{k}") for k in range(MOMENTS)])
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    middle = F.col("_lo") + (F.col("_bin") + 0.5) / BINS * F.col("_h")
    first = F.greatest(F.ceil((middle - REACH * F.col("_h") - F.col("_lo")) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((middle + REACH * F.col("_h") - F.col("_lo")) / step), F.lit(points - 1)).cast("int")
    near = bins.where(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    z = (F.col("_lo") + step * F.col("point") - middle) / F.col("_h")
    # The sum over k as one polynomial in z.
    powers = [reduce(lambda x, y: x + y, [F.col(f"_m{k}") * p[j] for k, p in enumerate(_hermite()) if j < len(p) and p[j]]) for j in range(MOMENTS)]
    kernel = reduce(lambda x, y: x * F.col("_z") + y, reversed(powers)) * F.exp(F.col("_z") * F.col("_z") * -0.5)
    summed = near.withColumn("_z", z).groupBy(*keys, *facts, "point").agg(F.sum(kernel).alias("_k"))
    # Grid points out of every kernel's reach have density 0.
    grid = shape.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    full = grid.join(summed.select(*keys, "point", "_k"), [*keys, "point"], "left")
    x = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / (points - 1)
    return full.select(
        *keys, "point", x.alias("x"), (F.coalesce("_k", F.lit(0.0)) / (F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi()))).alias("density"))


def regression_line(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """Least-squares line per group: slope, intercept, r2, n and the slope's standard error."""
    keys = [by] if by else []
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    one = both.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"))
    sse = F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx"))
    return one.select(
        *keys, "n", "slope", "intercept",
        F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx") * F.col("_syy")).alias("r2"),
        F.sqrt(F.try_divide(F.greatest(sse, F.lit(0.0)), (F.col("n") - 2) * F.col("_sxx"))).alias("slope_stderr"))


def moving_average(df: DataFrame, order: Sequence, col: str, n: int, by: Sequence[str] = (), name: str | None = None, **kw) -> DataFrame:
    """Mean of the last ``n`` rows; NULL until ``n`` values are there."""
    name = name or f"ma_{n}"
    out = trailing(df, order, n, {name: (F.avg, F.col(col)), "_seen": (F.count, F.col(col))}, by, **kw)
    return out.withColumn(name, F.when(F.col("_seen") == n, F.col(name))).drop("_seen")


def cumulative_sum(df: DataFrame, order: Sequence, col: str, by: Sequence[str] = (), name: str = "cumulative", **kw) -> DataFrame:
    return running(df, order, {name: F.col(col)}, by, **kw)


def trend_line(df: DataFrame, order: Sequence, col: str, **kw) -> DataFrame:
    """Row index, value and the fitted straight line over the index."""
    placed = with_position(df, order, name="idx", **kw)
    slope, icept = placed.agg(F.regr_slope(col, "idx"), F.regr_intercept(col, "idx")).first()
    return placed.withColumn("fitted", F.lit(icept) + F.lit(slope) * F.col("idx"))


def ecdf(df: DataFrame, col: str, key: str, **kw) -> DataFrame:
    """Sorted values with their cumulative share; equal values get steps of their own."""
    data = df.where(F.col(col).isNotNull()).select(key, col)
    n = data.count()
    placed = with_position(data, [col, key], name="pos", **kw)
    return placed.select(key, col, ((F.col("pos") + 1) / F.lit(n)).alias("cumulative"))


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile by the published rational approximation of P. J. Acklam (error < 1.2e-9)."""
    # The published coefficients.
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
    low = 0.02425

    def poly(coef: list[float], v: Column) -> Column:
        out = F.lit(coef[0])
        for k in coef[1:]:
            out = out * v + F.lit(k)
        return out

    q = p - 0.5
    r = q * q
    centre = poly(a, r) * q / poly(b, r)
    t = F.sqrt(-2.0 * F.log(F.when(p < 0.5, p).otherwise(1.0 - p)))
    tail = poly(c, t) / poly(d, t)
    return F.when(p < low, tail).when(p > 1.0 - low, -tail).otherwise(centre)


def qq_points(df: DataFrame, col: str, key: str, **kw) -> DataFrame:
    """Ordered values against normal quantiles at the medians of the order statistics."""
    data = df.where(F.col(col).isNotNull()).select(key, F.col(col).cast("double").alias("value"))
    n = data.count()
    placed = with_position(data, ["value", key], name="pos", **kw)
    rank = F.col("pos") + 1
    ends = 0.5 ** (1.0 / n) if n else 0.5
    p = F.when(rank == 1, F.lit(1.0 - ends)).when(rank == n, F.lit(ends)).otherwise((rank - 0.3175) / (n + 0.365))
    return placed.select(key, "value", inverse_normal(p).alias("theoretical"))


def minmax_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale to 0..1 over all rows; the bounds are scalar subqueries, not a window over everything."""
    bounds = df.agg(F.struct(*[e for c in cols for e in (
        F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"))])).scalar()
    return df.withColumns({
        f"{c}_scaled": F.try_divide(F.col(c) - bounds[f"lo_{c}"], bounds[f"hi_{c}"] - bounds[f"lo_{c}"]) for c in cols})
