"""Sanitise whole tables, count what changed, list what is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablesmith.functions.text import FORMULA_START, SCRIPT, SQL_PAIR, has_formula, has_script, has_sql, sanitize_text
from tablesmith.operators.profile import rows_from_wide
from tablesmith.schema import sanitize_columns, string_columns, valid_name


def sanitize_frame(df: DataFrame, cols: Sequence[str] | None = None, line_comments: str = "cell") -> DataFrame:
    """Clean every text column and the column names in one projection."""
    cols = list(cols or string_columns(df))
    return sanitize_columns(df.withColumns({c: sanitize_text(c, line_comments=line_comments) for c in cols}))


def count_sanitized_cells(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cells per text column that sanitising changes, in a single pass."""
    cols = list(cols or string_columns(df))
    wide = df.agg(F.count("*").alias("n_rows"), *[
        F.count_if(~F.col(c).eqNullSafe(sanitize_text(c))).alias(f"n__{i}") for i, c in enumerate(cols)])
    return rows_from_wide(wide, cols, {"n_changed": "n"}, ["n_rows"])


def count_changes(before: DataFrame, after: DataFrame, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Cells per text column that differ between two versions of a table, matched on a key."""
    cols = [c for c in (cols or string_columns(before)) if c in after.columns and c != key]
    a = before.select(key, *[F.col(c).alias(f"a{i}") for i, c in enumerate(cols)])
    b = after.select(key, *[F.col(c).alias(f"b{i}") for i, c in enumerate(cols)])
    wide = a.join(b, key).agg(*[
        F.count_if(~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))).alias(f"n__{i}") for i in range(len(cols))])
    return rows_from_wide(wide, cols, {"n_changed": "n"})


def scan_issues(df: DataFrame, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per finding: ``key, column, issue, excerpt, position``; bad column names have a null key.

    ``excerpt`` is the first text that gave rise to the finding, whole, and ``position`` where it starts, from 1.
    """
    cols = list(cols or [c for c in string_columns(df) if c != key])
    found = []
    for c in cols:
        for issue, test, pattern in (
                ("formula_detected", has_formula, FORMULA_START), ("script_detected", has_script, SCRIPT), ("sql_injection_detected", has_sql, SQL_PAIR)):
            match = F.regexp_substr(F.col(c), F.lit(pattern))
            found.append(F.when(test(c), F.struct(
                F.lit(c).alias("column"), F.lit(issue).alias("issue"), match.alias("excerpt"), F.position(match, F.col(c)).alias("position"))))
    cells = df.select(F.col(key), F.explode(F.array(*found)).alias("_x")).where("_x IS NOT NULL").select(key, "_x.*")
    bad = [c for c in df.columns if not valid_name(c)]
    if not bad:
        return cells
    names = df.sparkSession.createDataFrame([(c,) for c in bad], "column string").select(
        F.lit(None).cast(df.schema[key].dataType).alias(key), "column", F.lit("invalid_column_name").alias("issue"),
        F.col("column").alias("excerpt"), F.lit(1).alias("position"))
    return cells.unionByName(names)
