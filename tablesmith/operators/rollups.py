"""Grouped reports: metrics by group, month, pivot; totals and dashboard numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.schema import is_numeric

AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp,
}


def metric_columns(specs: dict[str, Sequence[str]], digits: int | None = 2) -> list[Column]:
    out = []
    for c, fns in specs.items():
        for fn in ([fns] if isinstance(fns, str) else fns):
            e = AGGREGATES[fn](c)
            out.append((e if fn == "count" or digits is None else F.round(e.cast("double"), digits)).alias(f"{c}_{fn}"))
    return out


def group_metrics(df: DataFrame, by: Sequence[str], specs: dict[str, Sequence[str]], digits: int | None = 2) -> DataFrame:
    return df.groupBy(*by).agg(*metric_columns(specs, digits))


def group_agg(df: DataFrame, by: str, col: str, fn: str) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(AGGREGATES[fn](col).alias(f"{fn}_{col}"))


def group_mean_std(df: DataFrame, by: str, col: str) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"))


def ratio_of_sums(df: DataFrame, by: str, num: str, den: str) -> DataFrame:
    return df.groupBy(by).agg(F.try_divide(F.sum(num).cast("double"), F.sum(den)).alias("ratio"))


#: Columns that a pivot may open.
MAX_WIDTH = 1000


def pivot_values(df: DataFrame, col: str, first: Sequence = (), width: int = MAX_WIDTH) -> list[tuple[str, object]]:
    """(column name, value) for every value of ``col``, those in ``first`` in front, then ascending; NULL is named ``null``.

    One distinct pass; only as many values as columns may open reach the driver, more are an error.
    """
    found = [r[0] for r in df.select(col).distinct().limit(width + 1).collect()]
    if len(found) > width:
        raise ValueError(f"{col} has more than {width} values; group by it instead of pivoting")
    known = list(first) + sorted((v for v in found if v is not None and v not in set(first)), key=lambda v: (str(type(v)), v))
    names = [(str(v), v) for v in known] + ([("null", None)] if None in found else [])
    if len({n for n, _ in names}) < len(names):
        raise ValueError(f"two values of {col} have the same column name")
    return names


def _wide(df: DataFrame, keys: Sequence[Column], col: str, values: Sequence[tuple[str, object]], agg) -> DataFrame:
    """One aggregate of one scan: a conditional aggregate per column."""
    if not values:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*[agg(F.col(col).eqNullSafe(F.lit(v))).alias(n) for n, v in values])


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str] | None = None, fn: str = "count", val: str | None = None, fill=None) -> DataFrame:
    """Pivot in two phases: find the values of ``col``, then aggregate once with a column for each.

    ``values`` only says which columns come first (and come even if empty); no row is left out, rows without a value
    get the column ``null``. Cells without rows are 0 for counts of rows and NULL otherwise, or ``fill``.
    """
    columns = pivot_values(df, col, values or ())

    def agg(test: Column) -> Column:
        return AGGREGATES[fn](F.when(test, F.lit(1) if val is None else F.col(val)))

    out = _wide(df, [F.col(row)], col, columns, agg)
    return out if fill is None else out.na.fill(fill, [n for n, _ in columns])


def month_of(ts: str) -> Column:
    return F.date_trunc("month", F.col(ts).cast("timestamp")).cast("date")


def rollup_month(df: DataFrame, ts: str, specs: dict[str, Sequence[str]], by: str | None = None, digits: int | None = 2) -> DataFrame:
    return df.groupBy(month_of(ts).alias("month"), *([by] if by else [])).agg(*metric_columns(specs, digits))


def month_by_category(df: DataFrame, ts: str, col: str, by: str, values: Sequence[str] | None = None) -> DataFrame:
    """Month by category sums, one column per category that occurs, 0 where there is none; see ``crosstab``."""
    columns = pivot_values(df, by, values or ())
    out = _wide(df, [month_of(ts).alias("month")], by, columns, lambda test: F.sum(F.when(test, F.col(col))))
    return out.na.fill(0, [n for n, _ in columns])


def seasonal(df: DataFrame, ts: str, col: str) -> DataFrame:
    return df.groupBy(F.month(ts).alias("calendar_month")).agg(F.avg(col).alias(f"mean_{col}"))


def _total(df: DataFrame, col: str) -> Column:
    return F.sum(F.col(col).cast("double")) if is_numeric(df, col) else F.count(col).cast("double")


def executive_summary(df: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Sum of each numeric metric, non-null count of the others, one row per metric."""
    named = {m: c for m, c in metrics.items() if c in df.columns}
    wide = df.agg(*[_total(df, c).alias(m) for m, c in named.items()])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in named])
    return wide.select(F.explode(cells).alias("_x")).select("_x.*")


def executive_trend(df: DataFrame, metrics: dict[str, str], ts: str) -> DataFrame:
    named = {m: c for m, c in metrics.items() if c in df.columns}
    return df.groupBy(month_of(ts).alias("month")).agg(*[_total(df, c).alias(m) for m, c in named.items()])


def kpi_totals(df: DataFrame, sums: Sequence[str], means: Sequence[str], ratio: tuple[str, str]) -> DataFrame:
    return df.agg(
        *[F.sum(c).alias(f"total_{c}") for c in sums], *[F.avg(c).alias(f"avg_{c}") for c in means],
        F.try_divide(F.sum(ratio[0]).cast("double"), F.sum(ratio[1])).alias("ratio"))


def value_share(df: DataFrame, col: str) -> DataFrame:
    """Counts of each value and its percentage of all non-null rows."""
    present = df.where(F.col(col).isNotNull())
    total = present.agg(F.count("*")).scalar()
    counts = present.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.lit(100.0) * F.col("n") / total)


def dashboard_cards(datasets: DataFrame, models: DataFrame) -> DataFrame:
    """Totals for the start page. ``datasets``: status; ``models``: status, r2. A zero r2 is not counted."""
    d = datasets.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ready").alias("ready"))
    m = models.agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.avg(F.when(F.col("r2") != 0, F.col("r2"))).alias("r2"))
    cards = lambda src, pairs: src.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("card"), v.cast("double").alias("value")) for k, v in pairs])).alias("_x")).select("_x.*")
    return cards(d, [("datasets", F.col("n")), ("datasets_ready", F.col("ready"))]).unionByName(
        cards(m, [("models", F.col("n")), ("models_completed", F.col("completed")),
                  ("average_r2", F.coalesce(F.round("r2", 3), F.lit(0.0)))]))
