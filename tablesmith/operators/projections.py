"""Selecting, filtering and deriving columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.schema import numeric_columns, require_columns

# Thresholds of the documented customer segments.
PREMIUM = (1000, 10)
STANDARD = 300


def select_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require_columns(df, list(cols))
    return df.select(*cols)


def numeric_features(df: DataFrame, target: str | None = None, max_cols: int | None = None) -> DataFrame:
    return df.select(*[c for c in numeric_columns(df) if c != target][:max_cols])


def equality_filters(df: DataFrame, **filters) -> DataFrame:
    """Keep rows that match every given value; ``None`` means no filter."""
    for name, value in filters.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def filtered_count(df: DataFrame, **filters) -> DataFrame:
    return equality_filters(df, **filters).agg(F.count("*").alias("n"))


def segment(total: Column, n: Column, premium=PREMIUM, standard=STANDARD) -> Column:
    """Premium, Standard or Budget from the money spent and the number of orders."""
    return (
        F.when((total > premium[0]) & (n > premium[1]), "Premium")
        .when(total > standard, "Standard")
        .otherwise("Budget")
    )


def with_residual(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))
