"""Display formats, safe arithmetic and date parts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def clip(c: str | Column, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; a missing value stays missing."""
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def _fixed(c: Column, pattern: str) -> Column:
    """Fixed decimals, rounded half-even on the exact binary value."""
    return F.call_function("format_number", c, F.lit(pattern))


def format_kpi(value: str | Column, kind: str = "number", change: str | Column | None = None) -> Column:
    """``$1,234``, ``12.34%`` or ``1,234``, with an arrow and the size of the change if given."""
    v = _col(value)
    if kind == "currency":
        text = F.when(v < 0, F.concat(F.lit("$-"), F.format_number(F.abs(v), 0))).otherwise(
            F.concat(F.lit("$"), F.format_number(v, 0)))
    elif kind == "percentage":
        text = F.concat(_fixed(v * 100, "0.00"), F.lit("%"))
    else:
        text = F.format_number(v, 0)
    if change is None:
        return text
    d = _col(change)
    arrow = F.when(d > 0, F.lit("↗")).otherwise(F.lit("↘"))
    tail = F.concat(F.lit(" "), arrow, F.lit(" "), _fixed(F.abs(d), "0.0"), F.lit("%"))
    return F.concat(text, F.coalesce(tail, F.lit("")))


def format_bytes(c: str | Column) -> Column:
    """File size with at most two decimals: ``0 Bytes``, ``1.5 KB``, ``3 MB``."""
    c = _col(c).cast("long")
    units = [("GB", 1024**3), ("MB", 1024**2), ("KB", 1024), ("Bytes", 1)]
    out = F.lit("0 Bytes")
    branch = None
    for unit, size in units:
        # Two decimals without trailing zeros.
        digits = F.format_string("%.2f", F.round(c / F.lit(size), 2))
        text = F.concat(F.regexp_replace(digits, r"\.?0+$", ""), F.lit(f" {unit}"))
        branch = F.when(c >= size, text) if branch is None else branch.when(c >= size, text)
    return branch.otherwise(F.when(c.isNotNull(), out))


def with_date_parts(df: DataFrame, c: str) -> DataFrame:
    return df.withColumns({
        "month": F.month(c),
        "quarter": F.quarter(c),
        "month_name": F.date_format(c, "MMMM"),
        "quarter_label": F.concat(F.lit("Q"), F.quarter(c).cast("string")),
    })


def fill_scoring(c: str | Column) -> Column:
    """Model input with missing values as 0 and infinities as the largest double of that sign."""
    c = _col(c).cast("double")
    big = 1.7976931348623157e308
    return F.coalesce(F.when(F.isnan(c), 0.0).when(c == float("inf"), big).when(c == float("-inf"), -big).otherwise(c), F.lit(0.0))


def minmax(c: str | Column, lo: Column, hi: Column) -> Column:
    return F.try_divide(_col(c) - lo, hi - lo)


def json_field(c: str | Column, field: str, type_: str) -> Column:
    return F.from_json(_col(c), f"`{field}` {type_}")[field]


def key_fingerprint(c: str | Column, length: int = 16) -> Column:
    return F.substring(F.sha2(_col(c).cast("string"), 256), 1, length)


def label_map(c: str | Column, mapping: dict) -> Column:
    """Look a value up in a small fixed mapping; unknown values give NULL."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _col(c))


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Make the main column functions callable from SQL as optimisable SQL functions."""
    from tablesmith.functions import text
    from tablesmith.operators import audit

    q = lambda s: "r'" + s.replace("'", "''") + "'" if "'" not in s else None
    removed = "c"
    for p in (text.FORMULA_PREFIX, text.SCRIPT, text.SQL_PAIR, text.COMMENT_TO_END, text.CONTROL):
        removed = f"regexp_replace({removed}, {q(p)}, '')"
    unsafe = " OR ".join(f"c RLIKE {q(p)}" for p in (
        text.FORMULA_START, text.SCRIPT, text.SQL_DROP, text.SQL_SELECT, text.SQL_UPDATE))
    bodies = {
        "ts_sanitize_text(c STRING)": ("STRING", removed),
        "ts_is_safe(c STRING)": ("BOOLEAN", f"NOT coalesce({unsafe}, false)"),
        "ts_safe_ratio(a DOUBLE, b DOUBLE)": ("DOUBLE", "try_divide(a, b)"),
        "ts_clip(c DOUBLE, lo DOUBLE, hi DOUBLE)": ("DOUBLE", "CASE WHEN c IS NOT NULL THEN greatest(least(c, hi), lo) END"),
        "ts_severity(risk STRING, outcome STRING, event_type STRING)": ("STRING", audit.severity_sql("risk", "outcome", "event_type")),
    }
    for head, (type_, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {type_} RETURN {body}")
    return [h.split("(")[0] for h in bodies]
