"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.operators import correlation as corr, profile
from tablesmith.plans.base import GAPPY_ORDERS_SQL, ORACLES, gappy_orders, nan_orders, query, rounded, table, union_sql

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_NUMBERS]
ORDER_TEXTS = ["o_orderstatus", "o_orderpriority"]
GAPPY = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("profile_shape", """
SELECT count(*) AS n_rows, 3 AS n_columns, 0 AS n_numeric, 3 AS n_text,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS n_duplicates
FROM documents""")
def profile_shape(spark, sf):
    return profile.profile_shape(table(spark, sf, "documents").select("text", "lang", "source"))


@query("missing_summary", f"WITH {GAPPY_ORDERS_SQL}" + union_sql([
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing, "
    f"round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_percent FROM gappy" for c in GAPPY]))
def missing_summary(spark, sf):
    return profile.missing_summary(gappy_orders(spark, sf))


@query("global_missing_pct", f"WITH {GAPPY_ORDERS_SQL}" + """
SELECT CAST(m AS BIGINT) AS n_missing, n * 5 AS n_cells, round(100.0 * m / (n * 5), 2) AS missing_percent
FROM (SELECT count(*) AS n, 5 * count(*) - count(o_orderkey) - count(o_custkey) - count(o_orderstatus)
             - count(o_totalprice) - count(o_orderpriority) AS m FROM gappy)""")
def global_missing_pct(spark, sf):
    return profile.global_missing_pct(gappy_orders(spark, sf))


def _numeric_sql(cols, source="lineitem"):
    return union_sql([f"""
SELECT '{c}' AS "column", count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std,
       round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS q25, round(quantile_cont(x, 0.5), 4) AS median,
       round(quantile_cont(x, 0.75), 4) AS q75, round(max(x), 4) AS max,
       round(avg(power(x - mu, 3)) / power(var_pop(x), 1.5), 4) AS skewness,
       round(avg(power(x - mu, 4)) / power(var_pop(x), 2) - 3, 4) AS kurtosis
FROM (SELECT CAST({c} AS DOUBLE) AS x, (SELECT avg({c}) FROM {source}) AS mu FROM {source})""" for c in cols])


@query("numeric_summary", _numeric_sql(LINE_ALL))
def numeric_summary(spark, sf):
    return profile.numeric_summary(table(spark, sf, "lineitem"))


@query("describe_table", union_sql([
    f"SELECT '{stat}' AS statistic, " + ", ".join(f"round(CAST({e.format(c=c)} AS DOUBLE), 4) AS {c}" for c in LINE_NUMBERS)
    + " FROM lineitem"
    for stat, e in [
        ("count", "count({c})"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"),
        ("q25", "quantile_cont({c}, 0.25)"), ("median", "quantile_cont({c}, 0.5)"), ("q75", "quantile_cont({c}, 0.75)"),
        ("max", "max({c})")]]))
def describe_table(spark, sf):
    return profile.describe_table(table(spark, sf, "lineitem"), LINE_NUMBERS)


def _counts_sql(cols, source):
    return union_sql([
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 2"
        for c in cols])


@query("categorical_summary", f"WITH {GAPPY_ORDERS_SQL}, counts AS ({_counts_sql(ORDER_TEXTS, 'gappy')})" + """
SELECT * FROM (
  SELECT "column", CAST(sum(n) OVER (PARTITION BY "column") AS BIGINT) AS count,
         count(*) OVER (PARTITION BY "column") AS "unique",
         row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, value, n AS frequency
  FROM counts) WHERE rank <= 10""")
def categorical_summary(spark, sf):
    return profile.categorical_summary(gappy_orders(spark, sf))


@query("topn_per_column", f"WITH counts AS ({_counts_sql(['c_nationkey', 'c_mktsegment', 'c_name'], 'customer')})" + """
SELECT * FROM (SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank
               FROM counts) WHERE rank <= 10""")
def topn_per_column(spark, sf):
    return profile.top_values(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment", "c_name"], 10)


KINDS = {"o_orderkey": ("bigint", "numeric"), "o_custkey": ("bigint", "numeric"), "o_orderstatus": ("string", "categorical"),
         "o_totalprice": ("double", "numeric"), "o_orderpriority": ("string", "categorical")}


@query("ingest_metadata", f"WITH {GAPPY_ORDERS_SQL}, head AS (SELECT * FROM gappy ORDER BY o_orderkey LIMIT 3)" + union_sql([
    f"SELECT {i} AS position, '{c}' AS \"column\", '{KINDS[c][0]}' AS data_type, '{KINDS[c][1]}' AS kind, count(*) AS n_rows, "
    f"count(*) - count({c}) AS n_missing, (SELECT string_agg(coalesce(CAST({c} AS VARCHAR), 'null'), ' | ' ORDER BY o_orderkey) FROM head) AS sample FROM gappy"
    for i, c in enumerate(GAPPY)]))
def ingest_metadata(spark, sf):
    return profile.ingest_metadata(gappy_orders(spark, sf), "o_orderkey")


def _safe_corr_sql(a, b):
    ok = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return (f"covar_pop({a}, {b}) {ok} / nullif(stddev_pop({a}) {ok} * stddev_pop({b}) {ok}, 0)")


CORR = ["o_orderkey", "o_custkey", "o_totalprice"]


@query("correlation_matrix", f"WITH {GAPPY_ORDERS_SQL}" + union_sql([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({_safe_corr_sql(a, b)}, 4) AS r FROM gappy" for a in CORR for b in CORR]))
def correlation_matrix(spark, sf):
    return rounded(corr.correlation_matrix(gappy_orders(spark, sf)))


LINE_EXTRA = {
    "price_tax": "l_extendedprice * (1 + l_tax)", "price_net": "l_extendedprice * (1 - l_discount)",
    "qty_sq": "l_quantity * l_quantity", "unit_price": "l_extendedprice / l_quantity",
    "gappy_qty": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END", "constant": "1.5",
}
LINE_WIDE = [*LINE_ALL, *LINE_EXTRA]
LINE_WIDE_SQL = "wide AS (SELECT " + ", ".join(LINE_ALL) + ", " + ", ".join(
    f"CAST({e} AS DOUBLE) AS {n}" for n, e in LINE_EXTRA.items()) + " FROM lineitem)"


def wide_lines(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE_ALL, *[
        F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in LINE_EXTRA.items()])


@query("correlation_matrix_wide", f"WITH {LINE_WIDE_SQL}" + union_sql([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({_safe_corr_sql(a, b)}, 4) AS r FROM wide"
    for a in LINE_WIDE for b in LINE_WIDE]))
def correlation_matrix_wide(spark, sf):
    return rounded(corr.correlation_matrix(wide_lines(spark, sf)))


def _pairs_sql(cols, source):
    return union_sql([
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_safe_corr_sql(a, b)} AS r FROM {source}"
        for i, a in enumerate(cols) for b in cols[i + 1:]])


@query("strong_correlations", f"WITH pairs AS ({_pairs_sql(LINE_NUMBERS, 'lineitem')})" + """
SELECT col_a, col_b, round(r, 4) AS r, round(abs(r), 4) AS abs_r FROM pairs WHERE abs(r) < 1.0
ORDER BY abs(r) DESC, col_a, col_b LIMIT 3""")
def strong_correlations(spark, sf):
    return rounded(corr.strong_correlations(table(spark, sf, "lineitem"), LINE_NUMBERS, 3))


@query("multicollinear_pairs", f"WITH {LINE_WIDE_SQL}, pairs AS ({_pairs_sql(LINE_WIDE, 'wide')})" + """
SELECT col_a, col_b, round(r, 4) AS r FROM pairs WHERE abs(r) > 0.8""")
def multicollinear_pairs(spark, sf):
    return rounded(corr.multicollinear_pairs(wide_lines(spark, sf)))


OUTLIER_SQL = "lo_hi AS (" + union_sql([
    f"SELECT '{c}' AS c, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
    f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events2)" for c in ("value", "value_sq")]) + ")"
EVENTS2_SQL = "events2 AS (SELECT event_id, value, value * value AS value_sq FROM events)"
CELLS_SQL = "cells AS (" + union_sql([
    f"SELECT event_id, '{c}' AS c, {c} AS v FROM events2" for c in ("value", "value_sq")]) + ")"


def events2(spark, sf):
    return table(spark, sf, "events").select("event_id", "value", (F.col("value") * F.col("value")).alias("value_sq"))


@query("outlier_summary_iqr", f"WITH {EVENTS2_SQL}, {OUTLIER_SQL}, {CELLS_SQL}" + """
SELECT cells.c AS "column", count(*) FILTER (WHERE v < lo OR v > hi) AS n_outliers,
       round(100.0 * count(*) FILTER (WHERE v < lo OR v > hi) / count(*), 2) AS outlier_percent
FROM cells JOIN lo_hi ON cells.c = lo_hi.c GROUP BY cells.c HAVING count(*) FILTER (WHERE v < lo OR v > hi) > 0""")
def outlier_summary_iqr(spark, sf):
    return profile.outlier_summary(events2(spark, sf), ["value", "value_sq"])


@query("outlier_examples_iqr", f"WITH {EVENTS2_SQL}, {OUTLIER_SQL}, {CELLS_SQL}" + """
SELECT "column", key, round(value, 4) AS value, rank FROM (
  SELECT cells.c AS "column", event_id AS key, v AS value,
         row_number() OVER (PARTITION BY cells.c ORDER BY event_id, v) AS rank
  FROM cells JOIN lo_hi ON cells.c = lo_hi.c WHERE v < lo OR v > hi) WHERE rank <= 20""")
def outlier_examples_iqr(spark, sf):
    return rounded(profile.outlier_examples(events2(spark, sf), "event_id", ["value", "value_sq"]))


@query("text_profile", r"""
SELECT doc_id, len(string_split(text, chr(10))) AS n_lines,
       len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s', '', 'g') <> '')) AS n_nonempty_lines,
       len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words,
       CAST(length(text) AS BIGINT) AS n_characters
FROM documents""")
def text_profile(spark, sf):
    return profile.text_profile(table(spark, sf, "documents"), "doc_id", "text")


@query("export_profile")
def export_profile(spark, sf):
    return profile.profile_json(gappy_orders(spark, sf), "o_orderkey")


# --- NaN is missing, and the paths for large tables on these tables too ---------------------------


@query("missing_summary_nan", ORACLES["missing_summary"])
def missing_summary_nan(spark, sf):
    return profile.missing_summary(nan_orders(spark, sf))


@query("global_missing_pct_nan", ORACLES["global_missing_pct"])
def global_missing_pct_nan(spark, sf):
    return profile.global_missing_pct(nan_orders(spark, sf))


@query("correlation_matrix_nan", ORACLES["correlation_matrix"])
def correlation_matrix_nan(spark, sf):
    return rounded(corr.correlation_matrix(nan_orders(spark, sf)))


@query("numeric_summary_large", ORACLES["numeric_summary"])
def numeric_summary_large(spark, sf):
    return profile.numeric_summary(table(spark, sf, "lineitem"), small_group=0, gather_rows=1000)


@query("outlier_summary_large", ORACLES["outlier_summary_iqr"])
def outlier_summary_large(spark, sf):
    return profile.outlier_summary(events2(spark, sf), ["value", "value_sq"], small_group=0, gather_rows=1000)
