"""Splits, scalers, encoders and task detection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.operators.cleaning import value_codes
from tablesmith.operators.quantiles import quantile_values
from tablesmith.schema import nan_to_null, string_columns


def _hash_word(key: str, seed: int, start: int) -> Column:
    """Four hex digits of the hash of seed and key: the same row always gets the same word."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return F.substring(digest, start, 4)


def split_column(key: str, test: float = 0.2, seed: int = 42) -> Column:
    return F.when(_hash_word(key, seed, 1) < f"{round(test * 65536):04x}", "test").otherwise("train")


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Repeatable train and test sets; independent of partitioning and of other rows."""
    side = split_column(key, test, seed)
    return df.where(side == "train"), df.where(side == "test")


def fold_column(key: str, folds: int = 5, seed: int = 42) -> Column:
    return F.pmod(F.conv(_hash_word(key, seed, 5), 16, 10).cast("int"), F.lit(folds))


@dataclass
class Scaler:
    """Centre and spread per column, fitted once, applied anywhere."""

    centre: dict[str, float]
    spread: dict[str, float]

    def expr(self, c: str) -> Column:
        return (F.col(c) - F.lit(self.centre[c])) / F.lit(self.spread[c])

    def sql(self, c: str) -> str:
        return f"((`{c}` - ({self.centre[c]!r}D)) / ({self.spread[c]!r}D))"

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expr(c) for c in self.centre})


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "standard") -> Scaler:
    """standard: mean and population deviation; minmax: minimum and range; robust: median and IQR. NaN is missing."""
    cols, df = list(cols), nan_to_null(df)
    if kind == "robust":
        q = quantile_values(df, cols, [0.25, 0.5, 0.75])
        centre, spread = {c: q[c][1] for c in q}, {c: q[c][2] - q[c][0] for c in q}
    elif kind in ("standard", "minmax"):
        pair = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, F.max)
        row = df.agg(*[e for c in cols for e in (pair[0](c).alias(f"a_{c}"), pair[1](c).alias(f"b_{c}"))]).first()
        known = [c for c in cols if row[f"a_{c}"] is not None]
        centre = {c: float(row[f"a_{c}"]) for c in known}
        spread = {c: float(row[f"b_{c}"]) - (centre[c] if kind == "minmax" else 0.0) for c in known}
    else:
        raise ValueError(f"unknown scaler: {kind}")
    # A constant column is only centred.
    return Scaler(centre, {c: s if s else 1.0 for c, s in spread.items()})


def _indicator(code: Column, n: Column) -> Column:
    """A sparse vector: its length, the place of the one, and the one; values outside the vocabulary have no place."""
    inside = code < n
    return F.struct(
        n.cast("int").alias("size"), F.when(inside, F.array(code)).otherwise(F.array().cast("array<int>")).alias("indices"),
        F.when(inside, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"))


def dense(onehot: str | Column) -> Column:
    """A sparse vector written out, for small vocabularies."""
    v = F.col(onehot) if isinstance(onehot, str) else onehot
    places = F.when(v["size"] > 0, F.sequence(F.lit(0), v["size"] - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_contains(v["indices"], i).cast("double"))


@dataclass
class Encoder:
    """Vocabulary tables of fitted text columns. They stay tables: a vocabulary may be large."""

    vocabularies: dict[str, DataFrame]
    sizes: dict[str, int]

    def apply(self, df: DataFrame, onehot: bool = False) -> DataFrame:
        """Add ``<c>_code`` (unseen and missing values get the next free code) and, if asked, ``<c>_onehot``.

        One-hot vectors are sparse (size, indices, values), so a row's size does not depend on the vocabulary.
        """
        for c, vocab in self.vocabularies.items():
            n = self.sizes[c]
            known = vocab.select(F.col("value").alias("_value"), F.col("code").cast("int").alias(f"{c}_code"))
            df = df.join(known, F.col(c) == F.col("_value"), "left").drop("_value")
            df = df.withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(n)))
            if onehot:
                code = F.col(f"{c}_code")
                df = df.withColumn(f"{c}_onehot", _indicator(code, F.lit(n)))
        return df


def fit_encoder(df: DataFrame, cols: Sequence[str] | None = None) -> Encoder:
    vocabularies = {c: value_codes(df, c) for c in (cols or string_columns(df))}
    return Encoder(vocabularies, {c: v.count() for c, v in vocabularies.items()})


def detect_task(df: DataFrame, target: str) -> str:
    """Text, or fewer than 20 distinct values, means classification."""
    if target in string_columns(df) or df.select(target).distinct().limit(20).count() < 20:
        return "classification"
    return "regression"
