"""Text sanitising and checks as column expressions (JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The patterns that count as dangerous. They must match the documented contract
# exactly. SPACE lists the Unicode white space that the contract's \s stands for.
SPACE = r"[\s\x0B\x1C-\x1F\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
FORMULA_START = r"^[=+\-@]"
FORMULA_PREFIX = r"^[=+\-@]+"
SCRIPT = r"(?isu)<script.*?>.*?</script>"
# The two-letter look-ahead only skips positions where no keyword can start.
SQL_PAIR = (
    r"(?=[DIUACESdiuaces\x{17F}][RrEeNnPpLlXx])"
    rf"(?iu:(DROP|DELETE|INSERT|UPDATE|ALTER|CREATE|EXEC|UNION|SELECT){SPACE}+(TABLE|DATABASE|INTO|FROM))"
)
COMMENT_TO_END = r"(?ms)--.*$|/\*.*?\*/"
COMMENT_TO_LINE_END = r"(?s)--[^\n]*|/\*.*?\*/"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
SQL_DROP = rf"(?iu)DROP{SPACE}+(TABLE|DATABASE)"
SQL_SELECT = rf"(?iu)SELECT{SPACE}+\*{SPACE}+FROM"
SQL_UPDATE = rf"(?iu)UPDATE{SPACE}+[\p{{L}}\p{{N}}_]+{SPACE}+SET"
# Texts that convert to a number. Testing the pattern first avoids a costly failed conversion per row.
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)\s*$"
INTEGER = r"^\s*[+-]?\d+\s*$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _remove(c: Column, *patterns: str) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, F.lit(p), F.lit(""))
    return c


def sanitize_text(c: str | Column, level: str = "full", line_comments: str = "cell", max_chars: int | None = None) -> Column:
    """Remove formula prefixes, scripts, SQL and control characters from a text.

    ``full``: every leading formula character, keyword pairs, comments.
    A ``--`` comment runs to the end of the cell (``line_comments='line'``: of its line).
    ``basic``: one leading formula character, three narrow SQL patterns, no comments.
    Texts stay whole unless ``max_chars`` asks for a cut.
    """
    if level == "basic":
        out = _remove(_col(c), FORMULA_START, SCRIPT, SQL_DROP, SQL_SELECT, SQL_UPDATE, CONTROL)
    else:
        comment = COMMENT_TO_END if line_comments == "cell" else COMMENT_TO_LINE_END
        out = _remove(_col(c), FORMULA_PREFIX, SCRIPT, SQL_PAIR, comment, CONTROL)
    return out if max_chars is None else F.substring(out, 1, max_chars)


def has_formula(c: str | Column) -> Column:
    return F.rlike(_col(c), F.lit(FORMULA_START))


def has_script(c: str | Column) -> Column:
    return F.rlike(_col(c), F.lit(SCRIPT))


def has_sql(c: str | Column) -> Column:
    return F.rlike(_col(c), F.lit(SQL_PAIR))


def is_safe(c: str | Column) -> Column:
    """No formula, script or narrow SQL pattern; a missing text is safe."""
    c = _col(c)
    bad = F.rlike(c, F.lit(FORMULA_START))
    for p in (SCRIPT, SQL_DROP, SQL_SELECT, SQL_UPDATE):
        bad = bad | F.rlike(c, F.lit(p))
    return ~F.coalesce(bad, F.lit(False))


def file_extension(c: str | Column) -> Column:
    """Lower-case suffix with its dot; names such as ``.hidden`` or ``name.`` have none."""
    base = F.element_at(F.split(_col(c), "/"), -1)
    return F.lower(F.regexp_extract(base, r"(?s)^.+(\.[^.]+)$", 1))


def sanitize_filename(c: str | Column) -> Column:
    """Base name with unsafe characters replaced, at most 255 long, never empty or hidden."""
    base = F.element_at(F.split(_col(c), "/"), -1)
    safe = F.regexp_replace(base, r'[<>:"|?*\\]', "_")
    # The suffix that survives the cut: the last dot part, unless the dot only leads the name.
    ext = F.regexp_extract(safe, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)
    stem = F.substring(safe, F.lit(1), F.length(safe) - F.length(ext))
    capped = F.when(F.length(safe) > 255, F.concat(F.substring(stem, F.lit(1), 255 - F.length(ext)), ext)).otherwise(safe)
    suffix = F.regexp_extract(capped, r"(?s)^.+(\.[^.]+)$", 1)
    fallback = F.concat(F.lit("uploaded_file"), F.when(suffix == "", F.lit(".txt")).otherwise(suffix))
    return F.when((capped == "") | capped.startswith("."), fallback).otherwise(capped)


#: Number types from narrow to wide; a column takes the narrowest that keeps all its values.
LATTICE = ["bigint", "decimal(38,0)", "double", "string"]


def type_tests(c: Column) -> list[Column]:
    """For a text column: how many values there are, and how many each type of the lattice but text cannot keep."""
    whole, digits = F.rlike(c, F.lit(INTEGER)), F.trim(c)
    return [F.count(c), *[F.count_if(c.isNotNull() & ~F.coalesce(whole & digits.try_cast(t).isNotNull(), F.lit(False))) for t in LATTICE[:2]],
            F.count_if(c.isNotNull() & ~F.rlike(c, F.lit(NUMBER)))]


def joined_type(counts: list[int]) -> str:
    """The lattice type that joins all values of a column, from the results of ``type_tests``; without values: double."""
    n, *lost = counts
    return "double" if not n else next((t for t, x in zip(LATTICE, lost) if not x), "string")


def as_type(name: str, kind: str) -> Column:
    return number_or_null(name) if kind == "double" else F.expr(f"try_cast(trim(`{name}`) AS {kind})") if kind != "string" else F.col(f"`{name}`")


def number_or_null(name: str) -> Column:
    """The double a text stands for, NULL where it is none."""
    c = F.col(f"`{name}`")
    return F.when(F.rlike(c, F.lit(NUMBER)), F.expr(f"try_cast(trim(`{name}`) AS double)"))
