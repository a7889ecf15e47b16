"""Sanitising and validation queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.functions import text
from tablesmith.operators import quality, sanitizing
from tablesmith.plans.base import GAPPY_ORDERS_SQL, gappy_orders, query, table, union_sql

# The patterns of the documented contract, in the check's dialect (RE2).
S = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SCRIPT = r"(?is)<script.*?>.*?</script>"
PAIR = rf"(?i)(DROP|DELETE|INSERT|UPDATE|ALTER|CREATE|EXEC|UNION|SELECT){S}+(TABLE|DATABASE|INTO|FROM)"
NARROW = [rf"(?i)DROP{S}+(TABLE|DATABASE)", rf"(?i)SELECT{S}+\*{S}+FROM", rf"(?i)UPDATE{S}+[\p{{L}}\p{{N}}_]+{S}+SET"]
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def _drop(c: str, *patterns: str) -> str:
    for p in patterns:
        c = f"regexp_replace({c}, '{p}', '', 'g')"
    return c


def full_sql(c: str) -> str:
    return _drop(c, r"^[=+\-@]+", SCRIPT, PAIR, r"(?ms)--.*$|/\*.*?\*/", CONTROL)


def basic_sql(c: str) -> str:
    return _drop(c, r"^[=+\-@]", SCRIPT, *NARROW, CONTROL)


# The given texts hold no dangerous cells; these versions add some by a rule on the key.
TAINTED_SQL = r"""tainted AS (SELECT doc_id, lang, CASE doc_id % 7 WHEN 0 THEN '=+' || text WHEN 1 THEN text || ' <SCRIPT src="x">a' || chr(10) || 'b</script> end'
WHEN 2 THEN text || ' drop   table users' WHEN 3 THEN text || ' select * from t where 1' WHEN 4 THEN '-' || text || chr(7) || ' /* note' || chr(10) || ' */ tail'
WHEN 5 THEN text || ' update Ab_1 set x' || ' -- rest' ELSE text END AS text FROM documents)"""


def tainted(spark, sf):
    m, t = F.col("doc_id") % 7, F.col("text")
    add = lambda s: F.concat(t, F.lit(s))
    return table(spark, sf, "documents").select(
        "doc_id", "lang",
        F.when(m == 0, F.concat(F.lit("=+"), t)).when(m == 1, add(' <SCRIPT src="x">a\nb</script> end')).when(m == 2, add(" drop   table users"))
        .when(m == 3, add(" select * from t where 1")).when(m == 4, F.concat(F.lit("-"), t, F.lit("\x07 /* note\n */ tail")))
        .when(m == 5, add(" update Ab_1 set x -- rest")).otherwise(t).alias("text"))


@query("sanitize_text", f"WITH {TAINTED_SQL} SELECT doc_id, {full_sql('text')} AS text FROM tainted")
def sanitize_text(spark, sf):
    return tainted(spark, sf).select("doc_id", text.sanitize_text("text").alias("text"))


@query("sanitize_pages", f"SELECT page_id, {full_sql('html')} AS html FROM pages")
def sanitize_pages(spark, sf):
    return sanitizing.sanitize_frame(table(spark, sf, "pages").select("page_id", "html"))


@query("sanitize_text_basic", f"WITH {TAINTED_SQL} SELECT doc_id, {basic_sql('text')} AS text FROM tainted")
def sanitize_text_basic(spark, sf):
    return tainted(spark, sf).select("doc_id", text.sanitize_text("text", level="basic").alias("text"))


def _match(c, p):
    return f"regexp_matches({c}, '{p}')"


@query("is_safe_text", f"WITH {TAINTED_SQL} SELECT doc_id, NOT (" + " OR ".join(
    _match("text", p) for p in [r"^[=+\-@]", SCRIPT, *NARROW]) + ") AS safe FROM tainted")
def is_safe_text(spark, sf):
    return tainted(spark, sf).select("doc_id", text.is_safe("text").alias("safe"))


@query("count_sanitized_cells", f"WITH {TAINTED_SQL}" + union_sql([
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER (WHERE {c} <> {full_sql(c)}) AS n_changed FROM tainted"
    for c in ("lang", "text")]))
def count_sanitized_cells(spark, sf):
    return sanitizing.count_sanitized_cells(tainted(spark, sf))


@query("count_changed_cells", f"WITH {TAINTED_SQL} SELECT 'text' AS \"column\", count(*) FILTER (WHERE a.text <> b.text) AS n_changed "
       "FROM documents a JOIN tainted b USING (doc_id)")
def count_changed_cells(spark, sf):
    before = table(spark, sf, "documents").select("doc_id", "text")
    return sanitizing.count_changes(before, tainted(spark, sf), "doc_id")


@query("scan_issues", f"WITH {TAINTED_SQL}" + union_sql([
    f"SELECT doc_id, '{c}' AS \"column\", '{issue}' AS issue, regexp_extract({c}, '{p}') AS excerpt, "
    f"CAST(position(regexp_extract({c}, '{p}') IN {c}) AS INTEGER) AS position FROM tainted WHERE {_match(c, p)}"
    for c in ("lang", "text")
    for issue, p in (("formula_detected", r"^[=+\-@]"), ("script_detected", SCRIPT), ("sql_injection_detected", PAIR))]))
def scan_issues(spark, sf):
    return sanitizing.scan_issues(tainted(spark, sf), "doc_id")


@query("quality_rules", f"WITH {GAPPY_ORDERS_SQL}" + """, q AS (
SELECT count(*) AS n, round(100.0 * (2 * count(*) - count(o_custkey) - count(o_orderpriority)) / (2 * count(*)), 2) AS pct FROM gappy)
SELECT severity, rule, n AS n_rows, pct AS missing_percent FROM (
  SELECT 'error' AS severity, 'no_rows' AS rule, n, pct, n = 0 AS hit FROM q UNION ALL
  SELECT 'warning', 'few_rows', n, pct, n BETWEEN 1 AND 9 FROM q UNION ALL
  SELECT 'error', 'mostly_missing', n, pct, pct > 50 FROM q UNION ALL
  SELECT 'warning', 'many_missing', n, pct, pct > 20 AND pct <= 50 FROM q) WHERE hit""")
def quality_rules(spark, sf):
    return quality.quality_report(gappy_orders(spark, sf).select("o_custkey", "o_orderpriority"))


NAMES_SQL = r"""names AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'report ' || page_id || '.exe.txt' WHEN 2 THEN '../up/' || page_id || '.php.csv'
WHEN 3 THEN 'dir/nul.' || page_id WHEN 4 THEN '.hidden' || substring(html, 1, page_id % 300) ELSE '' END AS name FROM pages)"""


def names(spark, sf):
    m, k = F.col("page_id") % 6, F.col("page_id").cast("string")
    return table(spark, sf, "pages").select(
        "page_id",
        F.when(m == 0, F.col("url")).when(m == 1, F.concat(F.lit("report "), k, F.lit(".exe.txt")))
        .when(m == 2, F.concat(F.lit("../up/"), k, F.lit(".php.csv"))).when(m == 3, F.concat(F.lit("dir/nul."), k))
        .when(m == 4, F.concat(F.lit(".hidden"), F.substring("html", F.lit(1), (F.col("page_id") % 300).cast("int")))).otherwise("").alias("name"))


RESERVED = ", ".join(f"'{n}'" for n in quality.RESERVED_NAMES)
EXECUTABLE = ", ".join(f"'{n}'" for n in quality.EXECUTABLE_EXTENSIONS)


@query("filename_rules", f"""WITH {NAMES_SQL}, base AS (
  SELECT *, list_extract(string_split(regexp_replace(name, '/+$', ''), '/'), -1) AS b, regexp_replace(name, '{S}', '', 'g') = '' AS blank FROM names),
ext AS (SELECT *, regexp_extract(b, '(?s)^.+(\\.[^.]+)$', 1) AS e FROM base),
r AS (SELECT page_id, unnest([
  CASE WHEN blank THEN 'error:empty_name' END,
  CASE WHEN NOT blank AND length(name) > 255 THEN 'error:name_too_long' END,
  CASE WHEN NOT blank AND regexp_matches(name, '[<>:"|?*\\x00]') THEN 'error:invalid_characters' END,
  CASE WHEN NOT blank AND (contains(name, '..') OR name LIKE '/%' OR starts_with(name, chr(92))) THEN 'error:path_traversal' END,
  CASE WHEN NOT blank AND upper(left(b, length(b) - length(e))) IN ({RESERVED}) THEN 'error:reserved_name' END,
  CASE WHEN NOT blank AND NOT regexp_matches(name, '^([a-zA-Z0-9._()\\[\\]-]|{S})+$') THEN 'error:unusual_characters' END,
  CASE WHEN lower(e) IN ({EXECUTABLE}) THEN 'error:executable_extension' END,
  CASE WHEN len(string_split(name, '.')) > 2 AND lower(list_extract(string_split(name, '.'), -2)) IN ('exe', 'bat', 'cmd', 'scr') THEN 'error:disguised_extension' END,
  CASE WHEN regexp_matches(lower(name), '\\.(php|asp|jsp|cgi)\\.') THEN 'warning:script_extension_inside' END]) AS f FROM ext)
SELECT page_id, string_split(f, ':')[1] AS severity, string_split(f, ':')[2] AS rule FROM r WHERE f IS NOT NULL""")
def filename_rules(spark, sf):
    return quality.filename_rules(names(spark, sf), "page_id", "name")


@query("sanitize_filename", f"""WITH {NAMES_SQL}, a AS (
  SELECT page_id, regexp_replace(list_extract(string_split(name, '/'), -1), '[<>:"|?*\\\\]', '_', 'g') AS n FROM names),
b AS (SELECT *, regexp_extract(n, '(?s)^\\.*[^.].*(\\.[^.]*)$', 1) AS e FROM a),
c AS (SELECT page_id, CASE WHEN length(n) > 255 THEN left(left(n, length(n) - length(e)), 255 - length(e)) || e ELSE n END AS n FROM b),
d AS (SELECT *, regexp_extract(n, '(?s)^.+(\\.[^.]+)$', 1) AS s FROM c)
SELECT page_id, CASE WHEN n = '' OR n LIKE '.%' THEN 'uploaded_file' || CASE WHEN s = '' THEN '.txt' ELSE s END ELSE n END AS name FROM d""")
def sanitize_filename(spark, sf):
    return names(spark, sf).select("page_id", text.sanitize_filename("name").alias("name"))


@query("file_extension", f"""WITH {NAMES_SQL} SELECT page_id,
lower(regexp_extract(list_extract(string_split(name, '/'), -1), '(?s)^.+(\\.[^.]+)$', 1)) AS extension FROM names""")
def file_extension(spark, sf):
    return names(spark, sf).select("page_id", text.file_extension("name").alias("extension"))


@query("file_size_rules", union_sql([
    f"SELECT page_id, '{s}' AS severity, '{r}' AS rule FROM (SELECT page_id, length(html) * (page_id % 4) * (page_id % 4) * (page_id % 4) * 1000 AS b FROM pages) WHERE {t}"
    for s, r, t in (("error", "empty_file", "b <= 0"), ("error", "file_too_large", "b > 104857600"), ("warning", "very_small_file", "b < 1024"))]))
def file_size_rules(spark, sf):
    m = F.col("page_id") % 4
    sizes = table(spark, sf, "pages").select("page_id", (F.length("html") * m * m * m * 1000).alias("size"))
    return quality.file_size_rules(sizes, "page_id", "size")


@query("training_data_rules", """SELECT 'error' AS severity, 'missing_feature' AS rule, 'no_such_column' AS "column"
UNION ALL SELECT 'error', 'target_not_numeric', 'o_orderstatus'
UNION ALL SELECT 'error', 'too_few_rows', 'o_orderstatus' FROM (SELECT count(o_orderstatus) AS n FROM orders) WHERE n < 10""")
def training_data_rules(spark, sf):
    return quality.training_report(table(spark, sf, "orders"), "o_orderstatus", ["o_totalprice", "no_such_column"])
