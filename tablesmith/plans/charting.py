"""Chart-data and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.operators import charts
from tablesmith.plans.base import GAPPY_ORDERS_SQL, ORACLES, gappy_orders, nan_orders, query, rounded, table


@query("histogram", """
WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
c AS (SELECT least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 30)) AS INTEGER), 29) AS bin, count(*) AS n FROM orders, b GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + (hi - lo) / 30 * g.bin, 4) AS left_edge, round(lo + (hi - lo) / 30 * (g.bin + 1), 4) AS right_edge,
       coalesce(n, 0) AS n
FROM (SELECT unnest(range(30)) AS bin) g CROSS JOIN b LEFT JOIN c ON c.bin = g.bin""")
def histogram(spark, sf):
    return rounded(charts.histogram(table(spark, sf, "orders"), "o_totalprice", 30))


@query("histogram_by_group", """
WITH b AS (SELECT event_type, count(*) AS t, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
c AS (SELECT event_type, least(CAST(floor((value - lo) / ((hi - lo) / 20)) AS INTEGER), 19) AS bin, count(*) AS n
      FROM events JOIN b USING (event_type) GROUP BY 1, 2)
SELECT b.event_type, CAST(g.bin AS INTEGER) AS bin, round(lo + (hi - lo) / 20 * g.bin, 4) AS left_edge,
       round(lo + (hi - lo) / 20 * (g.bin + 1), 4) AS right_edge, coalesce(n, 0) AS n,
       round(coalesce(n, 0) / (t * ((hi - lo) / 20)), 4) AS density
FROM (SELECT unnest(range(20)) AS bin) g CROSS JOIN b LEFT JOIN c ON c.bin = g.bin AND c.event_type = b.event_type""")
def histogram_by_group(spark, sf):
    return rounded(charts.histogram(table(spark, sf, "events"), "value", 20, density=True, by="event_type"))


def _box_sql(src, col, by):
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    join = f"JOIN f USING ({by})" if by else ", f"
    return f"""
WITH q AS (SELECT {key}quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS median, quantile_cont({col}, 0.75) AS q3 FROM {src}{group}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT {key}round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, count(*) AS n, round(min({col}), 4) AS min,
  round(max({col}), 4) AS max, round(min({col}) FILTER (WHERE {col} BETWEEN lo AND hi), 4) AS whisker_low,
  round(max({col}) FILTER (WHERE {col} BETWEEN lo AND hi), 4) AS whisker_high,
  count(*) FILTER (WHERE NOT {col} BETWEEN lo AND hi) AS n_outliers
FROM {src} {join} GROUP BY {key}q1, median, q3"""


@query("box_stats", _box_sql("events", "value", "event_type"))
def box_stats(spark, sf):
    return rounded(charts.box_stats(table(spark, sf, "events"), "value", "event_type"))


@query("box_stats_all", _box_sql("lineitem", "l_extendedprice", None))
def box_stats_all(spark, sf):
    return rounded(charts.box_stats(table(spark, sf, "lineitem"), "l_extendedprice"))


def _kde_sql(src, col, by):
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    join = f"JOIN g USING ({by})" if by else ", g"
    return f"""
WITH s AS (SELECT {key}count(*) AS n, min({col}) AS lo, max({col}) AS hi, stddev_samp({col}) * power(count(*), -0.2) AS h FROM {src}{group}),
g AS (SELECT s.*, CAST(i AS INTEGER) AS point, lo + (hi - lo) * i / 99 AS x FROM s, (SELECT unnest(range(100)) AS i))
SELECT {key}point, round(x, 4) AS x, round(sum(exp(-0.5 * power(({col} - x) / h, 2))) / (n * h * sqrt(2 * pi())) * {{scale}}, 6) AS density
FROM {src} {join} GROUP BY {key}point, x, n, h"""


def _scaled(df, scale):
    return df.withColumns({"x": F.round("x", 4), "density": F.round(F.col("density") * scale, 6)})


@query("kde_curve", _kde_sql("events", "value", "event_type").format(scale=1))
def kde_curve(spark, sf):
    return _scaled(charts.kde(table(spark, sf, "events"), "value", by="event_type"), 1)


@query("kde_grid_join", _kde_sql("orders", "o_totalprice", None).format(scale=1000000))
def kde_grid_join(spark, sf):
    # Densities of large values are tiny; both sides are scaled before rounding.
    return _scaled(charts.kde(table(spark, sf, "orders"), "o_totalprice"), 1000000)


@query("regression_line", """
SELECT l_returnflag, n, round(slope, 4) AS slope, round(icept, 4) AS intercept, round(r2, 4) AS r2,
       round(sqrt((syy - sxy * sxy / sxx) / ((n - 2) * sxx)), 4) AS slope_stderr FROM (
  SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS icept,
         regr_r2(l_extendedprice, l_quantity) AS r2, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy,
         regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem GROUP BY 1)""")
def regression_line(spark, sf):
    return rounded(charts.regression_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"))


@query("moving_average", """
SELECT o_orderkey, round(CASE WHEN count(*) OVER w7 = 7 THEN avg(o_totalprice) OVER w7 END, 4) AS ma_7,
       round(CASE WHEN count(*) OVER w30 = 30 THEN avg(o_totalprice) OVER w30 END, 4) AS ma_30 FROM orders
WINDOW w7 AS (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def moving_average(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    out = charts.moving_average(df, ["o_orderdate", "o_orderkey"], "o_totalprice", 7)
    out = charts.moving_average(out, ["o_orderdate", "o_orderkey"], "o_totalprice", 30)
    return rounded(out.select("o_orderkey", "ma_7", "ma_30"), 4, "ma_7", "ma_30")


@query("moving_average_by_group", """
SELECT event_id, user_id, round(CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END, 4) AS ma_7 FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def moving_average_by_group(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = charts.moving_average(df, ["ts", "event_id"], "value", 7, by=["user_id"])
    return rounded(out.select("event_id", "user_id", "ma_7"), 4, "ma_7")


@query("cumulative_sum", """SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey
ROWS UNBOUNDED PRECEDING), 2) AS cumulative FROM orders""")
def cumulative_sum(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return rounded(charts.cumulative_sum(df, ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", "cumulative"), 2, "cumulative")


@query("trend_line", """
WITH p AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders),
f AS (SELECT regr_slope(o_totalprice, idx) AS s, regr_intercept(o_totalprice, idx) AS i FROM p)
SELECT o_orderkey, idx, round(i + s * idx, 4) AS fitted FROM p, f""")
def trend_line(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return rounded(charts.trend_line(df, ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", "idx", "fitted"), 4, "fitted")


@query("ecdf", """SELECT o_orderkey, o_totalprice, round(row_number() OVER (ORDER BY o_totalprice, o_orderkey) / count(*) OVER (), 6) AS cumulative FROM orders""")
def ecdf(spark, sf):
    return rounded(charts.ecdf(table(spark, sf, "orders"), "o_totalprice", "o_orderkey"), 6, "cumulative")


@query("qq_points")
def qq_points(spark, sf):
    return rounded(charts.qq_points(table(spark, sf, "events"), "value", "event_id"), 6)


@query("minmax_across_groups", """
WITH g AS (SELECT o_orderpriority, avg(o_totalprice) AS mean_price, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT o_orderpriority, round((mean_price - min(mean_price) OVER ()) / (max(mean_price) OVER () - min(mean_price) OVER ()), 4) AS mean_price_scaled,
       round((n_orders - min(n_orders) OVER ()) * 1.0 / (max(n_orders) OVER () - min(n_orders) OVER ()), 4) AS n_orders_scaled FROM g""")
def minmax_across_groups(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean_price"), F.count("*").alias("n_orders"))
    out = charts.minmax_scale(g, ["mean_price", "n_orders"])
    return rounded(out.select("o_orderpriority", "mean_price_scaled", "n_orders_scaled"))




# --- NaN is missing, and the paths for large tables on these tables too ---------------------------

_HIST_GAPS = f"WITH {GAPPY_ORDERS_SQL}, known AS (SELECT o_totalprice FROM gappy WHERE o_totalprice IS NOT NULL)," + ORACLES["histogram"].replace(
    "FROM orders", "FROM known").replace("WITH b AS", " b AS", 1)


@query("histogram_nan", _HIST_GAPS)
def histogram_nan(spark, sf):
    return rounded(charts.histogram(nan_orders(spark, sf), "o_totalprice", 30))


@query("box_stats_by_group_large", ORACLES["box_stats"])
def box_stats_by_group_large(spark, sf):
    return rounded(charts.box_stats(table(spark, sf, "events"), "value", "event_type", small_group=0, gather_rows=500))


@query("box_stats_all_large", ORACLES["box_stats_all"])
def box_stats_all_large(spark, sf):
    return rounded(charts.box_stats(table(spark, sf, "lineitem"), "l_extendedprice", small_group=0, gather_rows=1000))


@query("cumulative_sum_with_gaps", f"""WITH {GAPPY_ORDERS_SQL} SELECT o_orderkey, round(sum(g.o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey
ROWS UNBOUNDED PRECEDING), 2) AS cumulative FROM gappy g JOIN orders USING (o_orderkey)""")
def cumulative_sum_with_gaps(spark, sf):
    dates = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    df = gappy_orders(spark, sf).select("o_orderkey", "o_totalprice").join(dates, "o_orderkey")
    return rounded(charts.cumulative_sum(df, ["o_orderdate", "o_orderkey"], "o_totalprice", small=0).select("o_orderkey", "cumulative"), 2, "cumulative")


@query("moving_average_large", ORACLES["moving_average"])
def moving_average_large(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    out = charts.moving_average(df, ["o_orderdate", "o_orderkey"], "o_totalprice", 7, small=0, block=500)
    out = charts.moving_average(out, ["o_orderdate", "o_orderkey"], "o_totalprice", 30, small=0, block=500)
    return rounded(out.select("o_orderkey", "ma_7", "ma_30"), 4, "ma_7", "ma_30")


@query("moving_average_by_group_large", ORACLES["moving_average_by_group"])
def moving_average_by_group_large(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = charts.moving_average(df, ["ts", "event_id"], "value", 7, by=["user_id"], small=0, block=20)
    return rounded(out.select("event_id", "user_id", "ma_7"), 4, "ma_7")


@query("trend_line_large", ORACLES["trend_line"])
def trend_line_large(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return rounded(charts.trend_line(df, ["o_orderdate", "o_orderkey"], "o_totalprice", small=0).select("o_orderkey", "idx", "fitted"), 4, "fitted")


@query("ecdf_large", ORACLES["ecdf"])
def ecdf_large(spark, sf):
    return rounded(charts.ecdf(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", small=0), 6, "cumulative")
