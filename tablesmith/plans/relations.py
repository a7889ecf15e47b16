"""Joins, rollups, paging and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.operators import joins, paging, rollups
from tablesmith.plans.base import GAPPY_ORDERS_SQL, day_text, gappy_orders, query, rounded, table, time_text, union_sql

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("catalog_lookup_join", """SELECT o_orderkey, c_name, c_mktsegment, n_name FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def catalog_lookup_join(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "c_nationkey")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = joins.enrich(table(spark, sf, "orders"), customer, "o_custkey")
    return joins.enrich(out, nation, "c_nationkey").select("o_orderkey", "c_name", "c_mktsegment", "n_name")


@query("orphan_rows", """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS
(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def orphan_rows(spark, sf):
    parent = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return joins.orphans(table(spark, sf, "customer"), parent, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("unseen_categories", """SELECT p_type AS value, count(*) AS n FROM part WHERE p_type NOT IN
(SELECT p_type FROM part WHERE p_size <= 2) GROUP BY p_type""")
def unseen_categories(spark, sf):
    part = table(spark, sf, "part")
    return joins.unseen_categories(part, part.where("p_size <= 2"), "p_type")


@query("unseen_replaced", """SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size <= 2)
THEN p_brand ELSE 'unknown' END AS p_brand FROM part""")
def unseen_replaced(spark, sf):
    part = table(spark, sf, "part")
    return joins.replace_unseen(part, part.where("p_size <= 2"), "p_brand").select("p_partkey", "p_brand")


@query("attach_predictions", """SELECT o_orderkey, o_totalprice, round(prediction, 2) AS prediction FROM orders
LEFT JOIN (SELECT l_orderkey, 1500 * sum(l_quantity) AS prediction FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def attach_predictions(spark, sf):
    predictions = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        (F.sum("l_quantity") * 1500.0).alias("prediction"))
    out = joins.attach_predictions(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), predictions, "o_orderkey")
    return rounded(out, 2, "prediction")


@query("group_metrics", """SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_totalprice), 2) AS o_totalprice_mean,
count(o_custkey) AS o_custkey_count FROM orders GROUP BY o_orderpriority""")
def group_metrics(spark, sf):
    return rollups.group_metrics(table(spark, sf, "orders"), ["o_orderpriority"], {
        "o_totalprice": ["sum", "mean"], "o_custkey": ["count"]})


@query("group_mean", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean_l_extendedprice FROM lineitem GROUP BY 1")
def group_mean(spark, sf):
    return rounded(rollups.group_agg(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", "mean"))


@query("group_sum", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem GROUP BY 1")
def group_sum(spark, sf):
    return rounded(rollups.group_agg(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", "sum"), 2)


@query("group_mean_std", "SELECT event_type, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std FROM events GROUP BY 1")
def group_mean_std(spark, sf):
    return rounded(rollups.group_mean_std(table(spark, sf, "events"), "event_type", "value"))


@query("ratio_of_sums", "SELECT l_shipmode_like AS l_linestatus, round(sum(l_extendedprice) / sum(l_quantity), 4) AS ratio FROM "
       "(SELECT l_linestatus AS l_shipmode_like, l_extendedprice, l_quantity FROM lineitem) GROUP BY 1")
def ratio_of_sums(spark, sf):
    return rounded(rollups.ratio_of_sums(table(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice", "l_quantity"))


@query("pivot_count", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", "
       "count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def pivot_count(spark, sf):
    return rollups.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", fill=0)


@query("pivot_count_gaps", f"WITH {GAPPY_ORDERS_SQL} SELECT coalesce(o_orderpriority, 'none') AS o_orderpriority, " + ", ".join(
    f"count(*) FILTER (WHERE o_orderstatus = '{x}') AS \"{x}\"" for x in "FOP") + ", count(*) FILTER (WHERE o_orderstatus IS NULL) AS \"null\" FROM gappy GROUP BY 1")
def pivot_count_gaps(spark, sf):
    return rollups.crosstab(gappy_orders(spark, sf), "o_orderpriority", "o_orderstatus", fill=0).na.fill("none", ["o_orderpriority"])


@query("pivot_mean", "SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS \"F\", "
       "round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS \"O\", "
       "round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS \"P\" FROM orders GROUP BY 1")
def pivot_mean(spark, sf):
    return rounded(rollups.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", fn="mean", val="o_totalprice"))


MONTH = "strftime(date_trunc('month', {}), '%Y-%m-%d')"


@query("monthly_rollup", f"""SELECT {MONTH.format('o_orderdate')} AS month, round(sum(o_totalprice), 2) AS o_totalprice_sum,
round(avg(o_totalprice), 2) AS o_totalprice_mean, count(o_custkey) AS o_custkey_count FROM orders GROUP BY 1""")
def monthly_rollup(spark, sf):
    out = rollups.rollup_month(table(spark, sf, "orders"), "o_orderdate", {"o_totalprice": ["sum", "mean"], "o_custkey": "count"})
    return out.withColumn("month", day_text("month"))


@query("monthly_by_category", f"SELECT {MONTH.format('o_orderdate')} AS month, " + ", ".join(
    f"round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderpriority = '{p}'), 0), 2) AS \"{p}\"" for p in PRIORITIES)
    + " FROM orders GROUP BY 1")
def monthly_by_category(spark, sf):
    out = rollups.month_by_category(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_orderpriority")
    return rounded(out, 2, *PRIORITIES).withColumn("month", day_text("month"))


@query("monthly_by_category_long", f"""SELECT {MONTH.format('ts')} AS month, event_type, round(sum(value), 2) AS value_sum,
round(avg(value), 2) AS value_mean FROM events GROUP BY 1, 2""")
def monthly_by_category_long(spark, sf):
    out = rollups.rollup_month(table(spark, sf, "events"), "ts", {"value": ["sum", "mean"]}, by="event_type")
    return out.withColumn("month", day_text("month"))


@query("seasonal_profile", "SELECT CAST(month(o_orderdate) AS INTEGER) AS calendar_month, round(avg(o_totalprice), 4) AS mean_o_totalprice FROM orders GROUP BY 1")
def seasonal_profile(spark, sf):
    return rounded(rollups.seasonal(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"))


METRICS = {"revenue": "o_totalprice", "orders": "o_orderstatus", "absent": "no_such_column"}


@query("executive_summary", union_sql([
    "SELECT 'revenue' AS metric, round(sum(o_totalprice), 2) AS value FROM orders",
    "SELECT 'orders', CAST(count(o_orderstatus) AS DOUBLE) FROM orders"]))
def executive_summary(spark, sf):
    return rounded(rollups.executive_summary(table(spark, sf, "orders"), METRICS), 2)


@query("executive_trend", f"""SELECT {MONTH.format('o_orderdate')} AS month, round(sum(o_totalprice), 2) AS revenue,
CAST(count(o_orderstatus) AS DOUBLE) AS orders FROM orders GROUP BY 1""")
def executive_trend(spark, sf):
    out = rollups.executive_trend(table(spark, sf, "orders"), METRICS, "o_orderdate")
    return rounded(out, 2).withColumn("month", day_text("month"))


@query("kpi_totals", """SELECT round(sum(l_extendedprice), 2) AS total_l_extendedprice, round(sum(l_quantity), 2) AS total_l_quantity,
round(avg(l_discount), 4) AS avg_l_discount, round(avg(l_tax), 4) AS avg_l_tax, round(sum(l_extendedprice) / sum(l_quantity), 4) AS ratio FROM lineitem""")
def kpi_totals(spark, sf):
    out = rollups.kpi_totals(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], ["l_discount", "l_tax"], ("l_extendedprice", "l_quantity"))
    out = rounded(out, 2, "total_l_extendedprice", "total_l_quantity")
    return rounded(out, 4, "avg_l_discount", "avg_l_tax", "ratio")


@query("value_share", "SELECT event_type AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 4) AS percent FROM events GROUP BY 1")
def value_share(spark, sf):
    return rounded(rollups.value_share(table(spark, sf, "events"), "event_type"))


@query("dashboard_cards", """
WITH d AS (SELECT CASE WHEN n_chars % 3 = 0 THEN 'processing' ELSE 'ready' END AS status FROM documents),
m AS (SELECT CASE WHEN toxic = 1 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN quality = 1 THEN 1.0 / (1 + doc_id % 9) END AS r2 FROM labels)
SELECT 'datasets' AS card, CAST(count(*) AS DOUBLE) AS value FROM d
UNION ALL SELECT 'datasets_ready', CAST(count(*) FILTER (WHERE status = 'ready') AS DOUBLE) FROM d
UNION ALL SELECT 'models', CAST(count(*) AS DOUBLE) FROM m
UNION ALL SELECT 'models_completed', CAST(count(*) FILTER (WHERE status = 'completed') AS DOUBLE) FROM m
UNION ALL SELECT 'average_r2', CAST(round(avg(r2) FILTER (WHERE r2 <> 0), 3) AS DOUBLE) FROM m""")
def dashboard_cards(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("n_chars") % 3 == 0, "processing").otherwise("ready").alias("status"))
    m = table(spark, sf, "labels").select(
        F.when(F.col("toxic") == 1, "failed").otherwise("completed").alias("status"),
        F.when(F.col("quality") == 1, F.lit(1.0) / (1 + F.col("doc_id") % 9)).alias("r2"))
    return rollups.dashboard_cards(d, m)


@query("page_newest_first", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created,
(SELECT count(*) FROM orders) AS total, (SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) FROM orders) AS pages,
3 < (SELECT ceil(count(*) / 20.0) FROM orders) AS has_next FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40""")
def page_newest_first(spark, sf):
    out = paging.page(table(spark, sf, "orders"), "o_orderdate", "o_orderkey", page=3, per_page=20)
    return out.select("o_orderkey", time_text("o_orderdate").alias("created"), "total", "pages", "has_next")


@query("head_preview", """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total_rows,
(SELECT count(*) FROM orders) > 50 AS truncated FROM orders ORDER BY o_orderkey LIMIT 50""")
def head_preview(spark, sf):
    return paging.preview(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 50, "o_orderkey")


@query("random_sample_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100")
def random_sample_n(spark, sf):
    return paging.sample_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey")


@query("scatter_sample", """SELECT event_id, user_id, value, event_type FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 2000""")
def scatter_sample(spark, sf):
    return paging.scatter_data(table(spark, sf, "events"), "user_id", "value", "event_id", color="event_type")


FEEDS_SQL = """
feed AS (
  SELECT 'dataset' AS kind, CAST(o_orderkey AS VARCHAR) AS id, 'order ' || o_orderkey AS title, o_orderdate AS created, o_orderstatus AS status FROM orders
  UNION ALL
  SELECT 'model', CAST(event_id AS VARCHAR), 'event ' || event_type, ts, NULL FROM events)
"""


def _feeds(spark, sf):
    d = table(spark, sf, "orders").select(
        F.lit("dataset").alias("kind"), F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("o_orderdate").alias("created"), F.col("o_orderstatus").alias("status"))
    m = table(spark, sf, "events").select(
        F.lit("model").alias("kind"), F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("event "), F.col("event_type")).alias("title"), F.col("ts").alias("created"))
    return [d, m]


@query("recent_activity", f"""WITH {FEEDS_SQL} SELECT kind, id, title, strftime(created, '%Y-%m-%d %H:%M:%S') AS created, status
FROM feed ORDER BY feed.created DESC, kind, id LIMIT 5""")
def recent_activity(spark, sf):
    return paging.recent_activity(_feeds(spark, sf), 5).withColumn("created", time_text("created"))


@query("union_feeds", f"WITH {FEEDS_SQL} SELECT kind, id, title, strftime(created, '%Y-%m-%d %H:%M:%S') AS created, status FROM feed")
def union_feeds(spark, sf):
    return paging.union_feeds(*_feeds(spark, sf)).withColumn("created", time_text("created"))


@query("union_same_header", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'""")
def union_same_header(spark, sf):
    o = table(spark, sf, "orders")
    sheets = [o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), o.select("o_orderkey"),
              *[o.where(F.col("o_orderstatus") == x).select("o_orderkey", "o_totalprice") for x in ("P", "O")]]
    return paging.union_same_header(sheets)[0]
