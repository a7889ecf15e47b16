"""Lookups, integrity checks and attaching results by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.operators.ordering import is_small


def enrich(df: DataFrame, dim: DataFrame, on, how: str = "left", small: int = 1_000_000) -> DataFrame:
    """Join a lookup table; broadcast it only when its counted size allows."""
    return df.join(F.broadcast(dim) if is_small(dim, small) else dim, on, how)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose (non-null) key has no parent."""
    keys = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_parent"), "left_anti")


def unseen_categories(df: DataFrame, vocabulary: DataFrame, col: str, vocab_col: str | None = None) -> DataFrame:
    """Values of ``col`` (with their counts) that the fitted vocabulary does not know."""
    known = vocabulary.select(F.col(vocab_col or col).alias("_known")).distinct()
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return counts.join(known, F.col("value") == F.col("_known"), "left_anti")


def replace_unseen(df: DataFrame, vocabulary: DataFrame, col: str, vocab_col: str | None = None, value: str = "unknown") -> DataFrame:
    known = vocabulary.select(F.col(vocab_col or col).alias("_known")).distinct()
    out = df.join(known, F.col(col) == F.col("_known"), "left")
    return out.withColumn(col, F.when(F.col("_known").isNotNull(), F.col(col)).otherwise(F.lit(value))).drop("_known")


def attach_predictions(df: DataFrame, predictions: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Glue predictions to their input rows by key."""
    return df.join(predictions, key, "left")
