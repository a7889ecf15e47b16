"""Rule checks: datasets, headers, file names and sizes, training data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.functions.text import SPACE
from tablesmith.operators.profile import percent
from tablesmith.schema import column_rules as header_rules, is_numeric, missing_columns, numeric_columns, nan_to_null

# Names, extensions and characters of the documented rules.
RESERVED_NAMES = [
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
]
EXECUTABLE_EXTENSIONS = [
    ".exe", ".bat", ".cmd", ".com", ".pif", ".scr", ".vbs", ".js", ".jar",
    ".app", ".deb", ".pkg", ".dmg", ".run", ".bin", ".sh", ".ps1",
]
DISGUISED = ["exe", "bat", "cmd", "scr"]
SCRIPT_PARTS = r"\.(php|asp|jsp|cgi)\."
BAD_NAME_CHARACTERS = r'[<>:"|?*\x00]'
USUAL_NAME = rf"^([a-zA-Z0-9._\-()\[\]]|{SPACE})+$"
MAX_FILE_BYTES = 100 * 1024 * 1024
SMALL_FILE_BYTES = 1024
MIN_SAMPLES = 10


def _findings(*rules: tuple[str, str, Column]) -> Column:
    return F.array(*[
        F.when(test, F.struct(F.lit(level).alias("severity"), F.lit(rule).alias("rule"))) for level, rule, test in rules])


def quality_report(df: DataFrame) -> DataFrame:
    """Findings about a whole table: ``severity, rule, value``. NaN is missing."""
    n_cols, df = len(df.columns), nan_to_null(df)
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    one = df.agg(F.count("*").alias("n_rows"), missing.alias("n_missing")).withColumn(
        "pct", F.coalesce(percent(F.col("n_missing"), F.col("n_rows") * n_cols), F.lit(0.0)))
    rules = _findings(
        ("error", "no_rows", F.col("n_rows") == 0),
        ("warning", "few_rows", (F.col("n_rows") > 0) & (F.col("n_rows") < 10)),
        ("error", "no_columns", F.lit(n_cols == 0)),
        ("warning", "single_column", F.lit(n_cols == 1)),
        ("error", "mostly_missing", F.col("pct") > 50),
        ("warning", "many_missing", (F.col("pct") > 20) & (F.col("pct") <= 50)),
        ("warning", "no_numeric_column", F.lit(n_cols > 0 and not numeric_columns(df))),
    )
    return one.select(F.explode(rules).alias("_x"), "n_rows", "pct").where("_x IS NOT NULL").select(
        "_x.severity", "_x.rule", "n_rows", F.col("pct").alias("missing_percent"))


def column_rules(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(header_rules(df.columns), "severity string, rule string, column string")


def _base_name(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def filename_rules(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row per broken file-name rule: ``key, severity, rule``."""
    c = F.coalesce(F.col(name), F.lit(""))
    blank = F.regexp_replace(c, SPACE, "") == ""
    base = _base_name(c)
    # Suffix: last dot part, unless the dot leads or ends the base name.
    ext = F.regexp_extract(base, r"(?s)^.+(\.[^.]+)$", 1)
    stem = F.upper(F.substring(base, F.lit(1), F.length(base) - F.length(ext)))
    parts = F.split(c, r"\.")
    rules = _findings(
        ("error", "empty_name", blank),
        ("error", "name_too_long", ~blank & (F.length(c) > 255)),
        ("error", "invalid_characters", ~blank & F.rlike(c, F.lit(BAD_NAME_CHARACTERS))),
        ("error", "path_traversal", ~blank & (c.contains("..") | c.startswith("/") | c.startswith("\\"))),
        ("error", "reserved_name", ~blank & stem.isin(RESERVED_NAMES)),
        ("error", "unusual_characters", ~blank & ~F.rlike(c, F.lit(USUAL_NAME))),
        ("error", "executable_extension", F.lower(ext).isin(EXECUTABLE_EXTENSIONS)),
        ("error", "disguised_extension", (F.size(parts) > 2) & F.lower(F.get(parts, F.size(parts) - 2)).isin(DISGUISED)),
        ("warning", "script_extension_inside", F.rlike(F.lower(c), F.lit(SCRIPT_PARTS))),
    )
    return df.select(F.col(key), F.explode(rules).alias("_x")).where("_x IS NOT NULL").select(key, "_x.severity", "_x.rule")


def file_size_rules(df: DataFrame, key: str, size: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    c = F.col(size)
    rules = _findings(
        ("error", "empty_file", c <= 0),
        ("error", "file_too_large", c > max_bytes),
        ("warning", "very_small_file", c < SMALL_FILE_BYTES),
    )
    return df.select(F.col(key), F.explode(rules).alias("_x")).where("_x IS NOT NULL").select(key, "_x.severity", "_x.rule")


def training_report(df: DataFrame, target: str, features: Sequence[str] = ()) -> DataFrame:
    """Why a table cannot be trained on; empty when it can."""
    spark = df.sparkSession
    found = [("error", "missing_feature", c) for c in missing_columns(df, list(features))]
    if target not in df.columns:
        return spark.createDataFrame([("error", "missing_target", target), *found], "severity string, rule string, column string")
    if not is_numeric(df, target):
        found.append(("error", "target_not_numeric", target))
    static = spark.createDataFrame(found, "severity string, rule string, column string")
    n = df.agg(F.count(target).alias("n"))
    rules = _findings(("error", "target_all_null", F.col("n") == 0), ("error", "too_few_rows", F.col("n") < MIN_SAMPLES))
    counted = n.select(F.explode(rules).alias("_x")).where("_x IS NOT NULL").select("_x.severity", "_x.rule", F.lit(target).alias("column"))
    return static.unionByName(counted)


def validate_training(df: DataFrame, target: str, features: Sequence[str] = ()) -> None:
    broken = training_report(df, target, features).collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['column']}" for r in broken))


def row_limit_report(df: DataFrame, n: int = 1_000_000) -> DataFrame:
    """``n_rows, row_limit, exceeded``: says whether a table is above a limit. No row is ever cut off."""
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(n).cast("long").alias("row_limit"), (F.col("n_rows") > n).alias("exceeded"))
