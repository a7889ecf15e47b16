"""Profiling: shape, missing values, numeric and categorical summaries, outliers, text counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tablesmith.operators.quantiles import exact_quantiles, quantile_values
from tablesmith.schema import nan_to_null, numeric_columns, string_columns


def percent(part, whole, digits: int = 2):
    return F.round(F.try_divide(F.lit(100.0) * part, whole), digits)


def rows_from_wide(wide: DataFrame, names: Sequence[str], fields: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Turn a one-row table with columns ``<field>__<i>`` into one row per name."""
    quoted = [c.replace("\\", "\\\\").replace("'", "\\'") for c in names]
    items = ", ".join(
        f"named_struct('column', '{c}', " + ", ".join(f"'{dst}', `{src}__{i}`" for dst, src in fields.items()) + ")"
        for i, c in enumerate(quoted))
    return wide.selectExpr(*keep, f"explode(array({items})) AS _x").select(*keep, "_x.*")


def profile_shape(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric and text column counts, and rows that repeat an earlier one."""
    if not df.columns:
        return df.sparkSession.range(1).select(
            F.lit(0).cast("long").alias("n_rows"), F.lit(0).alias("n_columns"), F.lit(0).alias("n_numeric"),
            F.lit(0).alias("n_text"), F.lit(0).cast("long").alias("n_duplicates"))
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_m"))
    return groups.agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("n_rows"), F.count("*").alias("_distinct")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(numeric_columns(df))).alias("n_numeric"),
        F.lit(len(string_columns(df))).alias("n_text"),
        (F.col("n_rows") - F.col("_distinct")).alias("n_duplicates"),
    )


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "position int, column string, data_type string")


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing cells (NULL or NaN) of every column."""
    wide = nan_to_null(df).agg(F.count("*").alias("n_rows"), *[
        F.count_if(F.col(c).isNull()).alias(f"m__{i}") for i, c in enumerate(df.columns)])
    return rows_from_wide(wide, df.columns, {"n_missing": "m"}, ["n_rows"]).withColumn(
        "missing_percent", percent(F.col("n_missing"), F.col("n_rows")))


def global_missing_pct(df: DataFrame) -> DataFrame:
    per_column = missing_summary(df)
    return per_column.agg(F.sum("n_missing").alias("n_missing"), F.sum("n_rows").alias("n_cells")).withColumn(
        "missing_percent", percent(F.col("n_missing"), F.col("n_cells")))


def central_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, deviation, extremes, skewness and excess kurtosis (population forms), one row per column.

    Plain sums of powers around the mean stay in generated code for any number of columns; the built-in
    moment aggregates outgrow it from a handful of columns on.
    """
    cols = list(cols)
    data = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_c{i}") for i, c in enumerate(cols)])
    means = [float(m or 0.0) for m in data.agg(*[F.expr(f"avg(_c{i})") for i in range(len(cols))]).first()]
    sums = []
    for i, m in enumerate(means):
        d = f"(_c{i} - ({m!r}D))"
        parts = {"n": f"count(_c{i})", "min": f"min(_c{i})", "max": f"max(_c{i})", "s1": f"sum({d})", "s2": f"sum({d} * {d})",
                 "s3": f"sum({d} * {d} * {d})", "s4": f"sum({d} * {d} * {d} * {d})", "c": f"{m!r}D"}
        sums += [F.expr(e).alias(f"{k}__{i}") for k, e in parts.items()]
    raw = rows_from_wide(data.agg(*sums), cols, {k: k for k in ("n", "min", "max", "s1", "s2", "s3", "s4", "c")}).where("n > 0")
    # The centre is off the exact mean by rounding only; e corrects for it.
    e, p2, p3, p4 = (F.col(k) / F.col("n") for k in ("s1", "s2", "s3", "s4"))
    m2 = F.greatest(p2 - e * e, F.lit(0.0))
    m3 = p3 - 3 * e * p2 + 2 * e * e * e
    m4 = p4 - 4 * e * p3 + 6 * e * e * p2 - 3 * e * e * e * e
    return raw.select(
        "column", "n", "min", "max", F.col("c").alias("mean"),
        F.sqrt(F.try_divide(m2 * F.col("n"), F.col("n") - 1)).alias("std"),
        F.try_divide(m3, F.pow(m2, F.lit(1.5))).alias("skewness"), (F.try_divide(m4, m2 * m2) - 3).alias("kurtosis"))


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False, digits: int = 4, **kw) -> DataFrame:
    """Moments and exact quartiles per numeric column, rounded; empty columns are left out."""
    cols = list(cols or numeric_columns(df))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], approx=approx, **kw)
    moments = central_moments(df, cols)
    r = lambda c: F.round(c, digits)
    # Both sides have one row per column.
    return q.drop("n").join(moments, "column").select(
        "column", F.col("n").alias("count"), r("mean").alias("mean"), r("std").alias("std"), r("min").alias("min"),
        r(F.col("q")[0]).alias("q25"), r(F.col("q")[1]).alias("median"), r(F.col("q")[2]).alias("q75"),
        r("max").alias("max"), r("skewness").alias("skewness"), r("kurtosis").alias("kurtosis"))


def describe_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per statistic."""
    cols = list(cols or numeric_columns(df))
    s = numeric_summary(df, cols)
    stats = ["count", "mean", "std", "min", "q25", "median", "q75", "max"]
    long = s.select("column", F.explode(F.array(*[
        F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias("v")) for n in stats])).alias("_x"))
    return long.groupBy(F.col("_x.statistic").alias("statistic")).agg(*[
        F.max(F.when(F.col("column") == c, F.col("_x.v"))).alias(c) for c in cols])


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts of the non-null values of several columns: ``column, value, n``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return (
        df.select(F.explode(cells).alias("_x")).select("_x.*").where("value is not null")
        .groupBy("column", "value").agg(F.count("*").alias("n"))
    )


def top_values(df: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """The ``n`` most frequent values per column. The rank filter is applied before the shuffle too."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return value_counts(df, cols).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    """Per text column: non-null count, distinct values, and its most frequent values by rank."""
    cols = list(cols or string_columns(df))
    counts = value_counts(df, cols)
    totals = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("unique"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    # One side has one row per column of the table, the other at most `top` of them.
    return ranked.join(totals, "column").select(
        "column", "count", "unique", "rank", "value", F.col("n").alias("frequency"))


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5, **kw) -> dict[str, tuple[float, float]]:
    """Tukey fences per column as plain numbers."""
    return {
        c: (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
        for c, (q1, q3) in quantile_values(df, cols, [0.25, 0.75], **kw).items()
    }


def outlier_cells(df: DataFrame, cols: Sequence[str], bounds: dict[str, tuple[float, float]], key: str) -> DataFrame:
    hits = F.array(*[
        F.when((F.col(c) < lo) | (F.col(c) > hi),
               F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")))
        for c, (lo, hi) in bounds.items()])
    return df.select(F.col(key).alias("key"), F.explode(hits).alias("_x")).where("_x IS NOT NULL").select("key", "_x.*")


def outlier_summary(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5, **kw) -> DataFrame:
    """Outliers per numeric column by Tukey fences; columns without any are left out. NaN is missing."""
    cols, df = list(cols or numeric_columns(df)), nan_to_null(df)
    bounds = iqr_bounds(df, cols, k, **kw)
    cols = list(bounds)
    wide = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(c).alias(f"n__{i}"),
        F.count_if((F.col(c) < bounds[c][0]) | (F.col(c) > bounds[c][1])).alias(f"o__{i}"))])
    return rows_from_wide(wide, cols, {"n": "n", "n_outliers": "o"}).where("n_outliers > 0").select(
        "column", "n_outliers", percent(F.col("n_outliers"), F.col("n")).alias("outlier_percent"))


def outlier_examples(df: DataFrame, key: str, cols: Sequence[str] | None = None, k: float = 1.5, examples: int = 20) -> DataFrame:
    """The first outliers of each column in key order."""
    cols = list(cols or numeric_columns(df))
    cells = outlier_cells(df, cols, iqr_bounds(df, cols, k), key)
    w = Window.partitionBy("column").orderBy("key", "value")
    return cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= examples)


def ingest_metadata(df: DataFrame, key: str, sample: int = 3) -> DataFrame:
    """What is recorded about a freshly loaded table, one row per column, with sample values."""
    groups = F.lit("other")
    for cols, label in ((numeric_columns(df), "numeric"), (string_columns(df), "categorical")):
        groups = F.when(F.col("column").isin(cols or [""]), F.lit(label)).otherwise(groups)
    head = df.orderBy(key).limit(sample)
    samples = head.agg(*[
        F.sort_array(F.collect_list(F.struct(F.col(key), F.col(c).cast("string").alias("v")))).alias(f"s__{i}")
        for i, c in enumerate(df.columns)])
    shown = rows_from_wide(samples, df.columns, {"_s": "s"}).select(
        "column", F.array_join(F.transform("_s", lambda x: F.coalesce(x["v"], F.lit("null"))), " | ").alias("sample"))
    types = column_types(df).withColumn("kind", groups)
    return missing_summary(df).join(types, "column").join(shown, "column").select(
        "position", "column", "data_type", "kind", "n_rows", "n_missing", "sample")


def text_profile(df: DataFrame, key: str, col: str) -> DataFrame:
    """Line, word and character counts of each text."""
    lines = F.split(F.col(col), "\n", -1)
    words = F.filter(F.split(F.col(col), r"[\s]+"), lambda w: w != "")
    return df.select(
        key,
        F.size(lines).alias("n_lines"),
        F.size(F.filter(lines, lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != "")).alias("n_nonempty_lines"),
        F.size(words).alias("n_words"),
        F.length(col).cast("long").alias("n_characters"))


def profile_document(df: DataFrame, key: str) -> DataFrame:
    """The whole profile in tidy form: ``section, column, statistic, value`` ready to be written."""
    from tablesmith.operators.correlation import correlation_matrix

    def tidy(section: str, table: DataFrame, stats: Sequence[str], label=None) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).cast("string").alias("value")) for s in stats])
        name = F.col("column") if label is None else label
        return table.select(F.lit(section).alias("section"), name.alias("column"), F.explode(cells).alias("_x")).select(
            "section", "column", "_x.*")

    parts = [
        tidy("summary", profile_shape(df), ["n_rows", "n_columns", "n_duplicates"], F.lit("*")),
        tidy("missing", missing_summary(df), ["n_missing", "missing_percent"]),
    ]
    if numeric_columns(df):
        parts.append(tidy("numeric", numeric_summary(df), [
            "count", "mean", "std", "min", "q25", "median", "q75", "max", "skewness", "kurtosis"]))
        parts.append(tidy("outliers", outlier_summary(df), ["n_outliers", "outlier_percent"]))
    if string_columns(df):
        cats = categorical_summary(df)
        parts.append(tidy("categorical", cats.where("rank = 1").select(
            "column", "count", "unique", F.col("value").alias("top_value"), F.col("frequency").alias("top_frequency")),
            ["count", "unique", "top_value", "top_frequency"]))
    if len(numeric_columns(df)) > 1:
        pairs = correlation_matrix(df)
        parts.append(pairs.select(
            F.lit("correlation").alias("section"), F.col("col_a").alias("column"), F.col("col_b").alias("statistic"),
            F.round("r", 4).cast("string").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_json(df: DataFrame, key: str) -> DataFrame:
    """One JSON text per profile section."""
    doc = profile_document(df, key)
    # The profile has a fixed number of rows per column of the table, whatever its row count.
    return doc.groupBy("section").agg(F.to_json(F.sort_array(F.collect_list(
        F.struct("column", "statistic", "value")))).alias("document"))
