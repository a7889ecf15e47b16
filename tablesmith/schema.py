"""Column groups and names, decided from the schema alone."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, types as T


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns; booleans and dates are in neither group."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN in floating columns into NULL so that all aggregates agree on what is missing."""
    out = {
        f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(out) if out else df


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: list[str]) -> None:
    lost = missing_columns(df, required)
    if lost:
        raise ValueError(f"columns not found: {lost}")


def trim_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def clean_name(name: str, position: int = 0) -> str:
    """One safe column name: letters, digits and underscores, not starting with a digit."""
    safe = re.sub(r"[^a-zA-Z0-9_]", "_", name)
    if safe[:1].isdigit():
        safe = f"col_{safe}"
    return f"column_{position}" if safe in ("", "_") else safe


def clean_names(names: list[str]) -> list[str]:
    """Safe, distinct names for a whole header; repeats get the first free ``_n`` suffix."""
    taken: dict[str, None] = {}
    for position, name in enumerate(names):
        base = clean_name(str(name), position)
        candidates = [base] + [f"{base}_{n}" for n in range(1, len(names) + 1)]
        taken[next(c for c in candidates if c not in taken)] = None
    return list(taken)


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def valid_name(name: str) -> bool:
    return re.match(r"^[a-zA-Z_][a-zA-Z0-9_]*$", name) is not None


def default_target(df: DataFrame) -> str:
    return df.columns[-1]


def column_rules(names: list[str]) -> list[tuple[str, str, str]]:
    """Findings about a header as (severity, rule, column)."""
    # Characters that make a column name awkward.
    awkward = set('<>:"|?*\n\r\t')
    found = []
    for position, name in enumerate(names):
        if not name or not name.strip():
            found.append(("error", "empty_name", str(position)))
        if name in names[:position]:
            found.append(("error", "duplicate_name", name))
        if awkward & set(name):
            found.append(("warning", "problem_characters", name))
        if len(name) > 100:
            found.append(("warning", "long_name", name))
    return found
