"""Cleaning, selection and derivation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.functions import formats
from tablesmith.operators import cleaning, paging, projections, quality
from tablesmith.plans.base import GAPPY_ORDERS_SQL, ORACLES, gappy_orders, nan_orders, query, rounded, table

G = f"WITH {GAPPY_ORDERS_SQL}"
GCOLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


@query("select_features", "SELECT l_extendedprice, l_quantity, l_tax FROM lineitem")
def select_features(spark, sf):
    return projections.select_features(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_tax"])


@query("numeric_only", "SELECT o_orderkey, o_custkey FROM orders")
def numeric_only(spark, sf):
    return projections.numeric_features(table(spark, sf, "orders"), "o_totalprice")


@query("drop_null_target", f"{G} SELECT {GCOLS} FROM gappy WHERE o_totalprice IS NOT NULL")
def drop_null_target(spark, sf):
    return cleaning.drop_null(gappy_orders(spark, sf), ["o_totalprice"])


@query("drop_rows_any_null", f"""{G} SELECT {GCOLS} FROM gappy WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL
AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL""")
def drop_rows_any_null(spark, sf):
    return cleaning.drop_rows_any_null(gappy_orders(spark, sf))


@query("drop_rows_all_null", f"""{G} SELECT o_custkey, o_totalprice, o_orderpriority FROM gappy
WHERE o_custkey IS NOT NULL OR o_totalprice IS NOT NULL OR o_orderpriority IS NOT NULL""")
def drop_rows_all_null(spark, sf):
    return cleaning.drop_empty_rows(gappy_orders(spark, sf).select("o_custkey", "o_totalprice", "o_orderpriority"))


@query("drop_sparse_columns", f"{G} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM gappy")
def drop_sparse_columns(spark, sf):
    return cleaning.drop_sparse_columns(gappy_orders(spark, sf), 0.5)


@query("equality_filters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def equality_filters(spark, sf):
    return projections.equality_filters(
        table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey", "o_totalprice")


@query("filtered_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def filtered_count(spark, sf):
    return projections.filtered_count(table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT")


@query("row_limit_report", "SELECT count(*) AS n_rows, CAST(10000 AS BIGINT) AS row_limit, count(*) > 10000 AS exceeded FROM orders")
def row_limit_report(spark, sf):
    return quality.row_limit_report(table(spark, sf, "orders"), 10_000)


@query("drop_duplicates", "SELECT DISTINCT text, lang, source FROM documents")
def drop_duplicates(spark, sf):
    return cleaning.drop_duplicates(table(spark, sf, "documents").select("text", "lang", "source"))


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def distinct_rows(spark, sf):
    return paging.distinct_rows(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


def _fill_sql(expr):
    return f"""{G} SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT {expr.format(c='o_totalprice')} FROM gappy)), 4) AS o_totalprice,
round(coalesce(o_custkey, (SELECT {expr.format(c='o_custkey')} FROM gappy)), 4) AS o_custkey FROM gappy"""


def _filled(spark, sf, method):
    df = gappy_orders(spark, sf).select("o_orderkey", "o_totalprice", "o_custkey")
    return rounded(cleaning.impute(df, method, ["o_totalprice", "o_custkey"]), 4, "o_totalprice", "o_custkey")


@query("impute_mean", _fill_sql("avg({c})"))
def impute_mean(spark, sf):
    return _filled(spark, sf, "mean")


@query("impute_median", _fill_sql("quantile_cont({c}, 0.5)"))
def impute_median(spark, sf):
    return _filled(spark, sf, "median")


def _mode_sql(c):
    return f"(SELECT {c} FROM gappy WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("impute_mode", f"""{G} SELECT o_orderkey,
round(CAST(coalesce(o_totalprice, {_mode_sql('o_totalprice')}) AS DOUBLE), 4) AS o_totalprice,
round(CAST(coalesce(o_custkey, {_mode_sql('o_custkey')}) AS DOUBLE), 4) AS o_custkey FROM gappy""")
def impute_mode(spark, sf):
    return _filled(spark, sf, "mode")


@query("impute_categorical", f"""{G} SELECT o_orderkey, coalesce(o_orderstatus, 'unknown') AS o_orderstatus,
coalesce(o_orderpriority, 'unknown') AS o_orderpriority FROM gappy""")
def impute_categorical(spark, sf):
    return cleaning.impute_strings(gappy_orders(spark, sf)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


def _fence(step, source, col):
    return f"""f{step} AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
  (SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3 FROM {source})),
s{step} AS (SELECT {source}.* FROM {source}, f{step} WHERE NOT coalesce({col} < lo OR {col} > hi, false))"""


EVENT_NUMBERS_SQL = """nums AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value,
value * value AS value_sq, sqrt(value) AS value_root FROM events)"""


def event_numbers(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 13 != 0, v).alias("value"), (v * v).alias("value_sq"), F.sqrt(v).alias("value_root"))


@query("remove_outliers_iqr", f"""WITH {EVENT_NUMBERS_SQL}, {_fence(1, 'nums', 'value')}, {_fence(2, 's1', 'value_sq')},
{_fence(3, 's2', 'value_root')}
SELECT event_id, round(value, 4) AS value, round(value_sq, 4) AS value_sq, round(value_root, 4) AS value_root FROM s3""")
def remove_outliers_iqr(spark, sf):
    return rounded(cleaning.remove_outliers(event_numbers(spark, sf), ["value", "value_sq", "value_root"]))


@query("clean_dataset", f"""WITH raw AS (SELECT lang, source, n_chars FROM documents),
dedup AS (SELECT DISTINCT * FROM raw), {_fence(1, 'dedup', 'n_chars')}
SELECT 0 AS step, 'input' AS action, count(*) AS n_rows, 3 AS n_columns FROM raw
UNION ALL SELECT 1, 'remove_duplicates', count(*), 3 FROM dedup
UNION ALL SELECT 2, 'fill_mean', count(*), 3 FROM dedup
UNION ALL SELECT 3, 'remove_outliers', count(*), 3 FROM s1""")
def clean_dataset(spark, sf):
    df = table(spark, sf, "documents").select("lang", "source", "n_chars")
    opts = cleaning.CleaningOptions(remove_duplicates=True, missing="fill_numeric", remove_outliers=True)
    return cleaning.clean(df, opts).log()


@query("preprocess_dataset", f"""{G}, filled AS (
  SELECT o_orderkey, o_orderpriority, coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM gappy)) AS p,
         coalesce(dense_rank() OVER (ORDER BY o_orderpriority NULLS LAST) - 1, -1) AS r FROM gappy),
coded AS (SELECT *, CASE WHEN o_orderpriority IS NULL THEN -1 ELSE r END AS code FROM filled)
SELECT o_orderpriority, round((o_orderkey - avg(o_orderkey) OVER ()) / stddev_pop(o_orderkey) OVER (), 4) AS o_orderkey,
       round((p - avg(p) OVER ()) / stddev_pop(p) OVER (), 4) AS o_totalprice,
       round((code - avg(code) OVER ()) / stddev_pop(code) OVER (), 4) AS o_orderpriority_encoded FROM coded""")
def preprocess_dataset(spark, sf):
    df = gappy_orders(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority")
    return rounded(cleaning.preprocess(df, cleaning.PreprocessOptions(missing="mean")))


@query("infer_numeric_columns", """SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price_text,
CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS VARCHAR) AS mixed_text FROM orders""")
def infer_numeric_columns(spark, sf):
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("string").alias("price_text"),
        F.when(k % 3 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("mixed_text"))
    return cleaning.infer_numeric(df)


_LONG = "'98765432109876' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0')"


@query("infer_numeric_ids", f"""SELECT o_orderkey, {_LONG} AS id20, 'decimal(38,0)' AS id20_type, o_orderkey + 9007199254740993 AS id16, 'bigint' AS id16_type,
{_LONG} || {_LONG} AS id40, 'string' AS id40_type FROM orders""")
def infer_numeric_ids(spark, sf):
    k = F.col("o_orderkey")
    long = F.concat(F.lit("98765432109876"), F.lpad(k.cast("string"), 6, "0"))
    df = table(spark, sf, "orders").select(
        "o_orderkey", long.alias("id20"), (k + 9007199254740993).cast("string").alias("id16"), F.concat(long, long).alias("id40"))
    out = cleaning.infer_numeric(df)
    return out.select("o_orderkey", F.col("id20").cast("string").alias("id20"), F.typeof("id20").alias("id20_type"), "id16", F.typeof("id16").alias("id16_type"),
                      F.col("id40").cast("string").alias("id40"), F.typeof("id40").alias("id40_type"))


@query("rule_segment", """SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n,
CASE WHEN sum(o_totalprice) > 1000000 AND count(*) > 10 THEN 'Premium' WHEN sum(o_totalprice) > 300000 THEN 'Standard'
ELSE 'Budget' END AS segment FROM orders GROUP BY o_custkey""")
def rule_segment(spark, sf):
    totals = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    # The tables hold large order values, so the money thresholds are scaled by 1000.
    seg = projections.segment(F.col("total"), F.col("n"), premium=(1_000_000, 10), standard=300_000)
    return totals.withColumn("segment", seg).withColumn("total", F.round("total", 2))


@query("label_map", """SELECT vec_id, CASE label WHEN 0 THEN 'High Value' WHEN 1 THEN 'Growth Potential'
WHEN 2 THEN 'At Risk' WHEN 3 THEN 'Standard' END AS segment_label FROM embeddings""")
def label_map(spark, sf):
    from tablesmith.operators.clustering import SEGMENT_LABELS
    return table(spark, sf, "embeddings").select(
        "vec_id", formats.label_map("label", SEGMENT_LABELS).alias("segment_label"))


@query("derive_date_parts", """SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
monthname(o_orderdate) AS month_name, 'Q' || quarter(o_orderdate) AS quarter_label FROM orders""")
def derive_date_parts(spark, sf):
    return formats.with_date_parts(table(spark, sf, "orders"), "o_orderdate").select(
        "o_orderkey", "month", "quarter", "month_name", "quarter_label")


@query("derive_ratios", """SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 8) AS unit_price,
round(l_discount / nullif(l_tax, 0), 8) AS discount_per_tax FROM lineitem""")
def derive_ratios(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(formats.safe_ratio("l_extendedprice", "l_quantity"), 8).alias("unit_price"),
        F.round(formats.safe_ratio("l_discount", "l_tax"), 8).alias("discount_per_tax"))


@query("clip_values", f"""{G} SELECT o_orderkey, CASE WHEN o_totalprice IS NOT NULL THEN greatest(least(o_totalprice, 200000.0), 50000.0) END AS clipped
FROM gappy""")
def clip_values(spark, sf):
    return gappy_orders(spark, sf).select("o_orderkey", formats.clip("o_totalprice", 50000.0, 200000.0).alias("clipped"))


@query("residuals", """SELECT l_orderkey, l_linenumber, round(l_extendedprice, 4) AS actual, round(1500 * l_quantity, 4) AS predicted,
round(l_extendedprice - 1500 * l_quantity, 4) AS residual FROM lineitem""")
def residuals(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("actual"), (F.lit(1500.0) * F.col("l_quantity")).alias("predicted"))
    return rounded(projections.with_residual(df, "actual", "predicted"), 4, "actual", "predicted", "residual")


@query("fill_zero_for_scoring", f"""{G} SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 1.7976931348623157e308
ELSE coalesce(o_totalprice, 0) END AS o_totalprice FROM gappy""")
def fill_zero_for_scoring(spark, sf):
    k = F.col("o_orderkey")
    df = gappy_orders(spark, sf).withColumn("o_totalprice", F.when(k % 19 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice")))
    return df.select("o_orderkey", formats.fill_scoring("o_totalprice").alias("o_totalprice"))


@query("format_kpi", """SELECT o_orderkey, '$' || format('{:,.0f}', o_totalprice) AS currency,
printf('%.2f%%', (o_totalprice / 1000000) * 100) AS percentage,
format('{:,.0f}', CAST(o_custkey AS DOUBLE)) || CASE WHEN o_custkey % 5 - 2 > 0 THEN ' ↗ ' ELSE ' ↘ ' END
  || printf('%.1f%%', abs(CAST(o_custkey % 5 - 2 AS DOUBLE))) AS number FROM orders""")
def format_kpi(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", formats.format_kpi("o_totalprice", "currency").alias("currency"),
        formats.format_kpi(F.col("o_totalprice") / 1000000, "percentage").alias("percentage"),
        formats.format_kpi(F.col("o_custkey").cast("double"), "number", (F.col("o_custkey") % 5 - 2).cast("double")).alias("number"))


@query("format_bytes", """SELECT doc_id, CASE
WHEN b >= 1073741824 THEN regexp_replace(printf('%.2f', round(b / 1073741824.0, 2)), '\\.?0+$', '') || ' GB'
WHEN b >= 1048576 THEN regexp_replace(printf('%.2f', round(b / 1048576.0, 2)), '\\.?0+$', '') || ' MB'
WHEN b >= 1024 THEN regexp_replace(printf('%.2f', round(b / 1024.0, 2)), '\\.?0+$', '') || ' KB'
WHEN b >= 1 THEN CAST(b AS VARCHAR) || ' Bytes' ELSE '0 Bytes' END AS size
FROM (SELECT doc_id, n_chars * (doc_id % 7) * n_chars AS b FROM documents)""")
def format_bytes(spark, sf):
    b = F.col("n_chars") * (F.col("doc_id") % 7) * F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", formats.format_bytes(b).alias("size"))


@query("json_details", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def json_details(spark, sf):
    return table(spark, sf, "events").select("event_id", formats.json_field("props", "k", "int").alias("k"))


@query("key_fingerprint", "SELECT c_custkey, substring(sha256(c_name), 1, 16) AS fingerprint FROM customer")
def key_fingerprint(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", formats.key_fingerprint("c_name").alias("fingerprint"))


@query("label_encode_sql", "SELECT DISTINCT p_brand AS value, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def label_encode_sql(spark, sf):
    return cleaning.value_codes(table(spark, sf, "part"), "p_brand")




# --- NaN is missing, and the paths for large tables on these tables too ---------------------------


def _filled_nan(spark, sf, method, **kw):
    df = nan_orders(spark, sf).select("o_orderkey", "o_totalprice", "o_custkey")
    return rounded(cleaning.impute(df, method, ["o_totalprice", "o_custkey"], **kw), 4, "o_totalprice", "o_custkey")


@query("impute_mean_nan", ORACLES["impute_mean"])
def impute_mean_nan(spark, sf):
    return _filled_nan(spark, sf, "mean")


@query("impute_mode_nan", ORACLES["impute_mode"])
def impute_mode_nan(spark, sf):
    return _filled_nan(spark, sf, "mode")


@query("impute_median_large", ORACLES["impute_median"])
def impute_median_large(spark, sf):
    return _filled_nan(spark, sf, "median", small_group=0, gather_rows=1000)


@query("impute_keeps_ids", f"""{G} SELECT o_orderkey + 9007199254740993 AS id, 'bigint' AS id_type, 'bigint' AS cust_type,
coalesce(o_custkey, (SELECT CAST(min(o_custkey) AS BIGINT) FROM (SELECT o_custkey, count(*) AS n FROM gappy WHERE o_custkey IS NOT NULL GROUP BY 1)
WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM gappy WHERE o_custkey IS NOT NULL GROUP BY o_custkey)))) AS o_custkey FROM gappy""")
def impute_keeps_ids(spark, sf):
    df = gappy_orders(spark, sf).select((F.col("o_orderkey") + 9007199254740993).alias("id"), "o_custkey")
    return cleaning.impute(df, "mode").select("id", F.typeof("id").alias("id_type"), F.typeof("o_custkey").alias("cust_type"), "o_custkey")


@query("drop_sparse_columns_nan", f"{G} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM gappy")
def drop_sparse_columns_nan(spark, sf):
    k = F.col("o_orderkey")
    sparse = gappy_orders(spark, sf).withColumn("mostly_nan", F.when(k % 5 < 3, F.lit(float("nan"))).otherwise(F.lit(1.0)))
    return cleaning.drop_sparse_columns(sparse, 0.5)
