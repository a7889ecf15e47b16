"""Cleaning and imputation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablesmith.functions.text import INTEGER, as_type, joined_type, type_tests
from tablesmith.operators.ordering import with_position
from tablesmith.operators.profile import iqr_bounds
from tablesmith.operators.quantiles import quantile_values
from tablesmith.schema import nan_to_null, numeric_columns, string_columns
from tablesmith.session import stable


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def drop_rows_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def sparse_columns(df: DataFrame, threshold: float = 0.5) -> list[str]:
    """Columns whose share of nulls (NaN is one) is above the threshold (one pass, one row of shares)."""
    shares = nan_to_null(df).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if (shares[c] or 0.0) > threshold]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    sparse = sparse_columns(df, threshold)
    if len(sparse) == len(df.columns):
        raise ValueError("every column is above the missing-value threshold")
    return df.drop(*sparse)


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def fill_values(df: DataFrame, method: str, cols: Sequence[str] | None = None, approx: bool = False, **kw) -> dict[str, float]:
    """The fill value of each numeric column: its mean, exact median or smallest mode. NaN is missing."""
    cols, df = list(cols or numeric_columns(df)), nan_to_null(df)
    if method == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    elif method == "median":
        row = {c: q[0] for c, q in quantile_values(df, cols, [0.5], approx=approx, **kw).items()}
    elif method == "mode":
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])
        counts = df.select(F.explode(cells).alias("_x")).where("_x.v is not null").groupBy("_x.c", "_x.v").count()
        # The most frequent value wins, the smallest one among equals.
        best = counts.groupBy("c").agg(F.max(F.struct("count", (-F.col("v")).alias("v"))).alias("b"))
        row = {r["c"]: -r["v"] for r in best.select("c", "b.v").collect()}
    else:
        raise ValueError(f"unknown fill method: {method}")
    return {c: float(v) for c, v in row.items() if v is not None}


def apply_fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Replace nulls and NaN. A column of whole numbers stays one when its fill value is whole; else it becomes double."""
    def filled(c: str, v: float) -> Column:
        kind = df.schema[c].dataType
        whole = isinstance(kind, T.IntegralType) and float(v).is_integer() or isinstance(kind, T.DecimalType)
        return F.coalesce(F.col(c), F.lit(v).cast(kind)) if whole else F.coalesce(F.col(c).cast("double"), F.lit(v))

    return nan_to_null(df).withColumns({c: filled(c, v) for c, v in values.items()})


def impute(df: DataFrame, method: str = "mean", cols: Sequence[str] | None = None, approx: bool = False, **kw) -> DataFrame:
    """Fill the gaps of numeric columns. Columns without gaps stay as they are, type and all, so ids keep their digits."""
    cols, known = list(cols or numeric_columns(df)), nan_to_null(df)
    if not cols:
        return df
    gaps = known.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"g{i}") for i, c in enumerate(cols)]).first()
    open_ = [c for i, c in enumerate(cols) if gaps[f"g{i}"]]
    return apply_fill(df, fill_values(known, method, open_, approx, **kw)) if open_ else df


def impute_strings(df: DataFrame, cols: Sequence[str] | None = None, value: str = "unknown") -> DataFrame:
    return df.na.fill(value, list(cols or string_columns(df)))


def remove_outliers(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Drop rows outside the fences, one column after the other, fences from the survivors so far.

    Rows with a null in the column stay. The fences are literals, so the growing filter reaches the
    scan and every step reads only the columns used so far.
    """
    df = nan_to_null(df)
    for c in list(cols or numeric_columns(df)):
        fence = iqr_bounds(df, [c], k).get(c)
        if fence:
            df = df.where(F.col(c).isNull() | F.col(c).between(*fence))
    return df


def infer_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Make text columns numbers where every non-null value is one, without changing any value.

    The narrowest of bigint, decimal(38,0) and double that keeps all values of a column, decided in one aggregate;
    whole numbers beyond 38 digits stay texts if they stand alone, since a double would merge them.
    """
    cols = list(cols or string_columns(df))
    if not cols:
        return df
    tests = [type_tests(F.col(f"`{c}`")) for c in cols]
    long = [F.count_if(F.rlike(F.col(f"`{c}`"), F.lit(INTEGER)) & F.trim(F.col(f"`{c}`")).try_cast("decimal(38,0)").isNull()) for c in cols]
    row = df.agg(*[e.alias(f"t{i}_{j}") for i, some in enumerate(tests) for j, e in enumerate(some)], *[e.alias(f"l{i}") for i, e in enumerate(long)]).first()
    kinds = {c: "string" if row[f"l{i}"] else joined_type([row[f"t{i}_{j}"] for j in range(4)]) for i, c in enumerate(cols)}
    return df.withColumns({c: as_type(c, kind) for c, kind in kinds.items() if kind != "string"})


@dataclass
class CleaningOptions:
    remove_duplicates: bool = False
    missing: str = "none"          # none, drop_rows, drop_columns, fill_numeric
    fill_method: str = "mean"
    missing_threshold: float = 0.5
    remove_outliers: bool = False
    outlier_columns: list[str] | None = None


@dataclass
class CleaningResult:
    data: DataFrame
    steps: list[tuple[str, DataFrame]] = field(default_factory=list)

    def log(self) -> DataFrame:
        """Rows and columns left after each step, counted without moving data to the driver."""
        out = None
        for i, (name, frame) in enumerate(self.steps):
            row = frame.agg(F.count("*").alias("n_rows")).select(
                F.lit(i).alias("step"), F.lit(name).alias("action"), "n_rows", F.lit(len(frame.columns)).alias("n_columns"))
            out = row if out is None else out.unionByName(row)
        return out


def clean(df: DataFrame, opts: CleaningOptions) -> CleaningResult:
    """Duplicates, then missing values, then outliers."""
    result = CleaningResult(df, [("input", df)])

    def step(name: str, frame: DataFrame) -> None:
        result.data = frame
        result.steps.append((name, frame))

    if opts.remove_duplicates:
        # Later steps read the table several times; the shuffle of the duplicates runs once.
        step("remove_duplicates", stable(drop_duplicates(result.data)))
    if opts.missing == "drop_rows":
        step("drop_rows", drop_rows_any_null(result.data))
    elif opts.missing == "drop_columns":
        sparse = sparse_columns(result.data, opts.missing_threshold)
        step("drop_columns", result.data.drop(*sparse))
    elif opts.missing == "fill_numeric":
        step(f"fill_{opts.fill_method}", impute(result.data, opts.fill_method))
    elif opts.missing != "none":
        raise ValueError(f"unknown missing-value strategy: {opts.missing}")
    if opts.remove_outliers:
        step("remove_outliers", remove_outliers(result.data, opts.outlier_columns))
    return result


def value_codes(df: DataFrame, col: str, small: int | None = None) -> DataFrame:
    """Alphabetical 0-based codes of the distinct non-null values: ``value, code``."""
    distinct = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    kw = {} if small is None else {"small": small}
    return with_position(distinct, ["value"], name="code", **kw)


@dataclass
class PreprocessOptions:
    missing: str | None = "drop"     # drop, mean or None
    encode: bool = True
    scale: bool = True


def preprocess(df: DataFrame, opts: PreprocessOptions) -> DataFrame:
    """Missing values, category codes (``<c>_encoded``, null is -1), then standard scaling of all numbers."""
    texts = string_columns(df)
    if opts.missing == "drop":
        df = drop_rows_any_null(df)
    elif opts.missing == "mean":
        df = impute(df, "mean")
    if opts.encode:
        for c in texts:
            codes = value_codes(df, c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            df = df.join(codes, F.col(c) == F.col("_value"), "left").withColumn(
                f"{c}_encoded", F.coalesce(F.col("_code"), F.lit(-1)).cast("int")).drop("_value", "_code")
    if opts.scale:
        cols = numeric_columns(df)
        stats = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
        df = df.withColumns({
            c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)
            for c in cols if stats[f"m_{c}"] is not None})
    return df
