"""Feature, regression, clustering, classification and registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.operators import classification, clustering, correlation, features, registry, regression, training
from tablesmith.operators.projections import with_residual
from tablesmith.operators.regression import RegressionConfig
from tablesmith.plans.base import GAPPY_ORDERS_SQL, ORACLES, gappy_orders, nan_orders, query, rounded, table, union_sql
from tablesmith.session import scratch_path

# The charge of a line is learnt from its parts.
X = ["l_extendedprice", "l_discount", "l_tax"]
Y = "charge"
LINES_SQL = "line AS (SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem)"
KEYED_SQL = f"{LINES_SQL}, keyed AS (SELECT *, l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS k FROM line)"


def charged_lines(spark, sf):
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, sf, "lineitem").withColumn("charge", charge)


def keyed_lines(spark, sf):
    k = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    return charged_lines(spark, sf).withColumn("k", k)


# --- split, scale, encode -----------------------------------------------------------------------


@query("split_train_test", "SELECT o_orderkey, CASE WHEN substring(md5('42:' || o_orderkey), 1, 4) < '3333' THEN 'test' ELSE 'train' END AS side FROM orders")
def split_train_test(spark, sf):
    train, test = features.split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


def _scale_sql(expr):
    return f"WITH {GAPPY_ORDERS_SQL} SELECT o_orderkey, " + ", ".join(
        f"round({expr.format(c=c)}, 4) AS {c}" for c in ("o_totalprice", "o_custkey")) + " FROM gappy"


def _scaled(spark, sf, kind):
    df = gappy_orders(spark, sf).select("o_orderkey", "o_totalprice", "o_custkey")
    return rounded(features.fit_scaler(df, ["o_totalprice", "o_custkey"], kind).apply(df), 4, "o_totalprice", "o_custkey")


@query("scale_standard", _scale_sql("({c} - (SELECT avg({c}) FROM gappy)) / (SELECT stddev_pop({c}) FROM gappy)"))
def scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


@query("scale_minmax", _scale_sql("({c} - (SELECT min({c}) FROM gappy)) / (SELECT CAST(max({c}) - min({c}) AS DOUBLE) FROM gappy)"))
def scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


@query("scale_robust", _scale_sql("({c} - (SELECT quantile_cont({c}, 0.5) FROM gappy)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM gappy)"))
def scale_robust(spark, sf):
    return _scaled(spark, sf, "robust")


@query("encode_labels", """
WITH v AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_size <= 2))
SELECT p_partkey, p_brand, CAST(coalesce(code, (SELECT count(*) FROM v)) AS INTEGER) AS p_brand_code FROM part LEFT JOIN v USING (p_brand)""")
def encode_labels(spark, sf):
    part = table(spark, sf, "part")
    encoder = features.fit_encoder(part.where("p_size <= 2"), ["p_brand"])
    return encoder.apply(part.select("p_partkey", "p_brand"))


@query("encode_onehot", "SELECT o_orderkey, " + " || ',' || ".join(
    f"CASE WHEN o_orderpriority = '{p}' THEN '1' ELSE '0' END"
    for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " AS onehot FROM orders")
def encode_onehot(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    out = features.fit_encoder(orders, ["o_orderpriority"]).apply(orders, onehot=True)
    return out.select("o_orderkey", F.array_join(F.transform(features.dense("o_orderpriority_onehot"), lambda v: v.cast("int").cast("string")), ",").alias("onehot"))


@query("detect_task_type", """SELECT 'o_orderstatus' AS target, 'classification' AS task UNION ALL
SELECT 'o_totalprice', CASE WHEN count(DISTINCT o_totalprice) < 20 THEN 'classification' ELSE 'regression' END FROM orders UNION ALL
SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) < 20 THEN 'classification' ELSE 'regression' END FROM lineitem""")
def detect_task_type(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return spark.createDataFrame(
        [(c, features.detect_task(df, c)) for df, c in ((orders, "o_orderstatus"), (orders, "o_totalprice"), (lines, "l_linenumber"))],
        "target string, task string")


# --- closed forms in SQL ------------------------------------------------------------------------


def _sums_sql(source: str, where: str = "true") -> str:
    """One row of covariances of three features a, b, c and the target z."""
    cols = dict(zip("abcz", [*X, Y]))
    pairs = ["aa", "ab", "ac", "bb", "bc", "cc", "az", "bz", "cz", "zz"]
    return "SELECT count(*) AS n, " + ", ".join(f"avg({v}) AS m{k}" for k, v in cols.items()) + ", " + ", ".join(
        f"covar_pop({cols[p[0]]}, {cols[p[1]]}) AS {p}" for p in pairs) + f" FROM {source} WHERE {where}"


def _det(m) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a}*({e}*{i}-{f}*{h}) - {b}*({d}*{i}-{f}*{g}) + {c}*({d}*{h}-{e}*{g}))"


def _solve_sql(name: str, source: str, l2: str = "0") -> str:
    """Three-feature ridge by Cramer's rule; ``l2`` is added to the diagonal of the covariances."""
    m = [[f"(aa+{l2})", "ab", "ac"], ["ab", f"(bb+{l2})", "bc"], ["ac", "bc", f"(cc+{l2})"]]
    rhs = ["az", "bz", "cz"]
    ws = []
    for j, w in enumerate(("wa", "wb", "wc")):
        mj = [[rhs[r] if k == j else m[r][k] for k in range(3)] for r in range(3)]
        ws.append(f"{_det(mj)} / {_det(m)} AS {w}")
    return f"{name} AS (SELECT *, mz - wa*ma - wb*mb - wc*mc AS w0 FROM (SELECT *, {', '.join(ws)} FROM {source}))"


def _coef_rows(source: str, digits: int) -> str:
    return union_sql([f"SELECT '{f}' AS feature, round({w}, {digits}) AS coefficient FROM {source}"
                      for f, w in zip(["(intercept)", *X], ["w0", "wa", "wb", "wc"])])


def _descent_sql(l1: float, l2: float) -> str:
    """Coordinate descent as a recursion over one row."""
    def step(d, r):
        return f"(sign({r}) * greatest(abs({r}) - {l1}, 0) / ({d} + {l2}))"

    return f"""
WITH RECURSIVE {LINES_SQL}, s AS ({_sums_sql('line')}),
cd(it, wa, wb, wc) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
  SELECT it + 1, a1, b1, {step('cc', '(cz - ac*a1 - bc*b1)')} FROM (
    SELECT *, {step('bb', '(bz - ab*a1 - bc*wc)')} AS b1 FROM (
      SELECT cd.*, s.*, {step('aa', '(az - ab*wb - ac*wc)')} AS a1 FROM cd, s WHERE it < 300))),
sol AS (SELECT wa, wb, wc, mz - wa*ma - wb*mb - wc*mc AS w0 FROM cd, s WHERE it = 300)
""" + _coef_rows("sol", 3)


def _fitted_rows(spark, sf, config):
    lines = charged_lines(spark, sf)
    m = regression.fit(lines, Y, X, config)
    return rounded(regression.coefficient_table(lines, X, m.coefficients, m.intercept), 3)


@query("fit_linear", f"WITH {LINES_SQL}, s AS ({_sums_sql('line')}), {_solve_sql('sol', 's')} {_coef_rows('sol', 3)}")
def fit_linear(spark, sf):
    return _fitted_rows(spark, sf, RegressionConfig("linear"))


@query("fit_ridge", f"WITH {LINES_SQL}, s AS ({_sums_sql('line')}), {_solve_sql('sol', 's', '(1.0 / n)')} {_coef_rows('sol', 3)}")
def fit_ridge(spark, sf):
    return _fitted_rows(spark, sf, RegressionConfig("ridge", alpha=1.0))


@query("fit_lasso", _descent_sql(1.0, 0.0))
def fit_lasso(spark, sf):
    return _fitted_rows(spark, sf, RegressionConfig("lasso", alpha=1.0))


@query("fit_elastic_net", _descent_sql(0.5, 0.5))
def fit_elastic_net(spark, sf):
    return _fitted_rows(spark, sf, RegressionConfig("elastic_net", alpha=1.0, l1_ratio=0.5))


FOLD_SQL = f"WITH {KEYED_SQL}, f AS (SELECT *, CAST('0x' || substring(md5('42:' || k), 5, 4) AS INTEGER) % 5 AS fold FROM keyed)"


def _cv_sql(alphas: list[str]) -> str:
    """Held-out R2 per fold (and ridge alpha), from training sums that leave the fold out."""
    parts = []
    for alpha in alphas:
        for fold in range(5):
            parts.append(f"""SELECT {fold} AS fold, {alpha} AS alpha, (SELECT 1 - avg(power({Y} - w0 - wa*{X[0]} - wb*{X[1]} - wc*{X[2]}, 2)) / var_pop({Y})
FROM f, (WITH s AS ({_sums_sql('f', f'fold <> {fold}')}), {_solve_sql('sol', 's', f'({alpha} / n)')} SELECT w0, wa, wb, wc FROM sol) AS z WHERE fold = {fold}) AS r2""")
    return union_sql(parts)


@query("cross_validate", f"{FOLD_SQL}, r AS ({_cv_sql(['0.0'])}) SELECT CAST(fold AS INTEGER) AS fold, round(r2, 4) AS r2, "
       "round((SELECT avg(r2) FROM r), 4) AS cv_mean, round((SELECT stddev_pop(r2) FROM r), 4) AS cv_std FROM r")
def cross_validate(spark, sf):
    return rounded(regression.cross_validate(keyed_lines(spark, sf), Y, X, "k"))


@query("grid_search", f"{FOLD_SQL}, r AS ({_cv_sql(['0.1', '1.0', '10.0', '100.0'])}), m AS (SELECT alpha, avg(r2) AS mean_r2 FROM r GROUP BY alpha) "
       "SELECT CAST(alpha AS DOUBLE) AS alpha, round(mean_r2, 4) AS mean_r2, mean_r2 = (SELECT max(mean_r2) FROM m) AS best FROM m")
def grid_search(spark, sf):
    return rounded(regression.grid_search(keyed_lines(spark, sf), Y, X, "ridge", "k").drop("l1_ratio"), 4, "mean_r2")


@query("grid_search_elastic_net")
def grid_search_elastic_net(spark, sf):
    return rounded(regression.grid_search(keyed_lines(spark, sf), Y, X, "elastic_net", "k", scaling="standard"))


@query("select_kbest", f"WITH {LINES_SQL} " + union_sql([
    f"SELECT * FROM (SELECT feature, round(r, 4) AS r, round(r * r / (1 - r * r) * (n - 2), 3) AS f_score FROM ("
    + union_sql([f"SELECT '{f}' AS feature, corr({f}, {Y}) AS r, count(*) AS n FROM line"
                 for f in ["l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_quantity"]])
    + ") ORDER BY r * r / (1 - r * r) * (n - 2) DESC, feature LIMIT 3)"]))
def select_kbest(spark, sf):
    out = correlation.select_kbest(
        charged_lines(spark, sf), ["l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_quantity"], Y, 3)
    return out.withColumns({"r": F.round("r", 4), "f_score": F.round("f_score", 3)})


@query("select_rfe", f"""WITH {LINES_SQL}, s AS ({_sums_sql('line')}), {_solve_sql('sol', 's')},
w AS (SELECT 0 AS i, 'l_extendedprice' AS feature, abs(wa) AS v FROM sol UNION ALL SELECT 1, 'l_discount', abs(wb) FROM sol UNION ALL SELECT 2, 'l_tax', abs(wc) FROM sol)
SELECT feature, CAST(CASE WHEN v = (SELECT min(v) FROM w) THEN 2 ELSE 1 END AS INTEGER) AS rank, v > (SELECT min(v) FROM w) AS selected FROM w""")
def select_rfe(spark, sf):
    return regression.select_rfe(charged_lines(spark, sf), X, Y, 2)


@query("feature_importance", f"""WITH {LINES_SQL}, s AS ({_sums_sql('line')}), {_solve_sql('sol', 's')}, w AS (SELECT wa, wb, wc, abs(wa) + abs(wb) + abs(wc) AS t FROM sol)
SELECT 'l_extendedprice' AS feature, round(abs(wa) / t, 4) AS importance FROM w UNION ALL SELECT 'l_discount', round(abs(wb) / t, 4) FROM w
UNION ALL SELECT 'l_tax', round(abs(wc) / t, 4) FROM w""")
def feature_importance(spark, sf):
    lines = charged_lines(spark, sf)
    m = regression.fit(lines, Y, X)
    return regression.feature_importance(regression.coefficient_table(lines, X, m.coefficients, m.intercept))


@query("rank_importance", f"""WITH {LINES_SQL}, s AS ({_sums_sql('line')}), {_solve_sql('sol', 's')}
SELECT *, abs(coefficient) AS abs_value FROM ({_coef_rows('sol', 3)}) WHERE feature <> '(intercept)'""")
def rank_importance(spark, sf):
    from tablesmith.operators.paging import rank_importance as rank
    lines = charged_lines(spark, sf)
    w, b = regression.solve(regression.moments(lines, [*X, Y])[0], RegressionConfig())
    return rank(rounded(regression.coefficient_table(lines, X, w, b).where("feature <> '(intercept)'"), 3))


@query("predict_batch", f"""WITH {LINES_SQL}, s AS ({_sums_sql('line')}), {_solve_sql('sol', 's')}
SELECT l_orderkey, l_linenumber, l_partkey, round(w0 + wa*l_extendedprice + wb*l_discount + wc*l_tax, 2) AS prediction FROM line, sol""")
def predict_batch(spark, sf):
    lines = charged_lines(spark, sf)
    m = regression.fit(lines, Y, X)
    return rounded(m.predict(lines).select("l_orderkey", "l_linenumber", "l_partkey", "prediction"), 2, "prediction")


@query("predict_many_tables", f"""WITH {LINES_SQL}, s AS ({_sums_sql('line')}), {_solve_sql('sol', 's')},
p AS (SELECT l_returnflag, w0 + wa*l_extendedprice + wb*l_discount + wc*l_tax AS prediction FROM line, sol)
SELECT 'flag_' || l_returnflag AS dataset_id, 'success' AS status, count(*) AS n, round(avg(prediction), 3) AS mean_prediction FROM p GROUP BY l_returnflag
UNION ALL SELECT 'orders', 'error', NULL, NULL""")
def predict_many_tables(spark, sf):
    lines = charged_lines(spark, sf)
    m = regression.fit(lines, Y, X)
    tables = {f"flag_{f}": lines.where(F.col("l_returnflag") == f) for f in ("A", "N", "R")}
    tables["orders"] = table(spark, sf, "orders")
    scored, status = regression.predict_many(m.model, tables, X)
    means = scored.groupBy("dataset_id").agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 3).alias("mean_prediction"))
    return status.drop("error").join(means, "dataset_id", "left")


PRED_SQL = f"{LINES_SQL}, p AS (SELECT {Y} AS y, l_extendedprice AS yhat, {Y} - l_extendedprice AS e FROM line)"


@query("regression_metrics", f"""WITH {PRED_SQL}, m AS (SELECT count(*) AS n, avg(e*e) AS mse, avg(abs(e)) AS mae, var_pop(y) AS vy, var_pop(e) AS ve,
avg(abs(e / y)) FILTER (WHERE y <> 0) AS mape FROM p)
SELECT n, round(1 - mse/vy, 4) AS r2, round(1 - (mse/vy) * (1000 - 1) / (1000 - 3 - 1), 4) AS adjusted_r2, round(mse, 4) AS mse, round(mae, 4) AS mae,
round(sqrt(mse), 4) AS rmse, round(mape, 4) AS mape, round(1 - ve/vy, 4) AS explained_variance FROM m""")
def regression_metrics(spark, sf):
    df = charged_lines(spark, sf).withColumn("yhat", F.col("l_extendedprice"))
    return regression.regression_metrics(df, Y, "yhat", n_train=1000, p=3)


@query("residual_diagnostics", f"""WITH {PRED_SQL}, d AS (SELECT e, (SELECT avg(e) FROM p) AS mu FROM p),
m AS (SELECT count(*) AS n, avg(e) AS mean, stddev_samp(e) AS std, avg(power(e-mu,3)) / power(var_pop(e), 1.5) AS sk, avg(power(e-mu,4)) / power(var_pop(e), 2) - 3 AS ku FROM d)
SELECT n, round(mean, 4) AS mean, round(std, 4) AS std, round(sk, 4) AS skewness, round(ku, 4) AS kurtosis, round(n / 6.0 * (sk*sk + ku*ku/4), 2) AS jarque_bera,
round(exp(-n / 12.0 * (sk*sk + ku*ku/4)), 4) AS p_value, exp(-n / 12.0 * (sk*sk + ku*ku/4)) > 0.05 AS looks_normal FROM m""")
def residual_diagnostics(spark, sf):
    df = charged_lines(spark, sf).withColumn("yhat", F.col("l_extendedprice"))
    out = regression.residual_diagnostics(with_residual(df, Y, "yhat"))
    return rounded(rounded(out, 2, "jarque_bera"), 4, "mean", "std", "skewness", "kurtosis", "p_value")


SIDE_SQL = f"WITH {KEYED_SQL}, f AS (SELECT *, CASE WHEN substring(md5('42:' || k), 1, 4) < '3333' THEN 'test' ELSE 'train' END AS side FROM keyed)"


@query("compare_models", f"""{SIDE_SQL}, s AS ({_sums_sql('f', "side = 'train'")}), {_solve_sql('lin', 's')}, {_solve_sql('rid', 's', '(1.0 / n)')},
sol AS (SELECT 'linear' AS model, w0, wa, wb, wc FROM lin UNION ALL SELECT 'ridge', w0, wa, wb, wc FROM rid),
e AS (SELECT model, side, {Y} AS y, {Y} - w0 - wa*{X[0]} - wb*{X[1]} - wc*{X[2]} AS r FROM f, sol),
m AS (SELECT model, 1 - avg(r*r) FILTER (WHERE side = 'train') / var_pop(y) FILTER (WHERE side = 'train') AS train_r2,
  1 - avg(r*r) FILTER (WHERE side = 'test') / var_pop(y) FILTER (WHERE side = 'test') AS test_r2,
  avg(r*r) FILTER (WHERE side = 'train') AS train_mse, avg(r*r) FILTER (WHERE side = 'test') AS test_mse,
  avg(abs(r)) FILTER (WHERE side = 'test') AS test_mae FROM e GROUP BY model)
SELECT model, round(train_r2, 4) AS train_r2, round(test_r2, 4) AS test_r2, round(train_mse, 1) AS train_mse, round(test_mse, 1) AS test_mse,
round(test_mae, 3) AS test_mae, round(train_r2 - test_r2, 4) AS overfit_gap, abs(train_r2 - test_r2) > 0.1 AS overfits,
row_number() OVER (ORDER BY test_r2 DESC, model) = 1 AS best FROM m""")
def compare_models(spark, sf):
    out = regression.compare_models(keyed_lines(spark, sf), Y, X, {
        "linear": RegressionConfig("linear"), "ridge": RegressionConfig("ridge", 1.0)}, "k")
    return rounded(rounded(rounded(out, 1, "train_mse", "test_mse"), 3, "test_mae"), 4, "train_r2", "test_r2", "overfit_gap")


@query("compare_models_scaled")
def compare_models_scaled(spark, sf):
    return rounded(regression.compare_models(keyed_lines(spark, sf), Y, X, {
        "Linear Regression": RegressionConfig("linear"), "Ridge Regression": RegressionConfig("ridge", 1.0, scaling="standard"),
        "Lasso Regression": RegressionConfig("lasso", 0.1, scaling="standard")}, "k"))


# --- the same on rows with gaps -------------------------------------------------------------------


def gappy_lines(spark, sf):
    """Lines with missing prices, discounts that are NaN, and missing targets."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return keyed_lines(spark, sf).withColumns({
        X[0]: F.when(p % 7 != 0, F.col(X[0])), X[1]: F.when(p % 5 == 0, F.lit(float("nan"))).otherwise(F.col(X[1])), Y: F.when(s % 11 != 0, F.col(Y))})


def _filled_sql(means_from: str = "true") -> str:
    """``keyed`` rows with a target, gaps filled with the means of the rows that ``means_from`` selects."""
    side = "CASE WHEN substring(md5('42:' || k), 1, 4) < '3333' THEN 'test' ELSE 'train' END AS side"
    fold = "CAST('0x' || substring(md5('42:' || k), 5, 4) AS INTEGER) % 5 AS fold"
    fill = ", ".join(f"coalesce({c}, avg({c}) FILTER (WHERE {means_from}) OVER ()) AS {c}" for c in X)
    return f"""WITH {KEYED_SQL}, g AS (SELECT k, {side}, {fold}, CASE WHEN l_partkey % 7 <> 0 THEN {X[0]} END AS {X[0]},
CASE WHEN l_partkey % 5 <> 0 THEN {X[1]} END AS {X[1]}, {X[2]}, {Y} FROM keyed WHERE l_suppkey % 11 <> 0),
f AS (SELECT k, side, fold, {fill}, {Y} FROM g)"""


@query("cross_validate_gaps", f"{_filled_sql()}, r AS ({_cv_sql(['0.0'])}) SELECT CAST(fold AS INTEGER) AS fold, round(r2, 4) AS r2, "
       "round((SELECT avg(r2) FROM r), 4) AS cv_mean, round((SELECT stddev_pop(r2) FROM r), 4) AS cv_std FROM r")
def cross_validate_gaps(spark, sf):
    return rounded(regression.cross_validate(gappy_lines(spark, sf), Y, X, "k"))


@query("grid_search_gaps", f"{_filled_sql()}, r AS ({_cv_sql(['0.1', '1.0', '10.0', '100.0'])}), m AS (SELECT alpha, avg(r2) AS mean_r2 FROM r GROUP BY alpha) "
       "SELECT CAST(alpha AS DOUBLE) AS alpha, round(mean_r2, 4) AS mean_r2, mean_r2 = (SELECT max(mean_r2) FROM m) AS best FROM m")
def grid_search_gaps(spark, sf):
    return rounded(regression.grid_search(gappy_lines(spark, sf), Y, X, "ridge", "k").drop("l1_ratio"), 4, "mean_r2")


@query("select_rfe_gaps", f"""{_filled_sql()}, s AS ({_sums_sql('f')}), {_solve_sql('sol', 's')},
w AS (SELECT '{X[0]}' AS feature, abs(wa) AS v FROM sol UNION ALL SELECT '{X[1]}', abs(wb) FROM sol UNION ALL SELECT '{X[2]}', abs(wc) FROM sol)
SELECT feature, CAST(CASE WHEN v = (SELECT min(v) FROM w) THEN 2 ELSE 1 END AS INTEGER) AS rank, v > (SELECT min(v) FROM w) AS selected FROM w""")
def select_rfe_gaps(spark, sf):
    return regression.select_rfe(gappy_lines(spark, sf), X, Y, 2)


def _measured_sql(fits: str) -> str:
    """Quality of the models in ``sol`` on both sides; ``fits`` are the tables that make it."""
    return f"""{_filled_sql("side = 'train'")}, {fits},
e AS (SELECT model, side, {Y} AS y, {Y} - w0 - wa*{X[0]} - wb*{X[1]} - wc*{X[2]} AS r FROM f, sol),
m AS (SELECT model, 1 - avg(r*r) FILTER (WHERE side = 'train') / var_pop(y) FILTER (WHERE side = 'train') AS train_r2,
  1 - avg(r*r) FILTER (WHERE side = 'test') / var_pop(y) FILTER (WHERE side = 'test') AS test_r2,
  avg(r*r) FILTER (WHERE side = 'test') AS test_mse FROM e GROUP BY model)
SELECT model, round(train_r2, 4) AS train_r2, round(test_r2, 4) AS test_r2, round(test_mse, 1) AS test_mse,
row_number() OVER (ORDER BY test_r2 DESC, model) = 1 AS best FROM m"""


def _ridge_scaled_sql(name: str, spreads: list[str]) -> str:
    """Ridge with alpha n / 2 on scaled features: the penalty of each coefficient grows with its squared spread."""
    ds = [f"(0.5 * power({x}, 2))" for x in spreads]
    m = [[f"(aa+{ds[0]})", "ab", "ac"], ["ab", f"(bb+{ds[1]})", "bc"], ["ac", "bc", f"(cc+{ds[2]})"]]
    ws = [f"{_det([[rhs if k == j else m[r][k] for k in range(3)] for r, rhs in enumerate(('az', 'bz', 'cz'))])} / {_det(m)} AS {w}" for j, w in enumerate(("wa", "wb", "wc"))]
    return f"{name} AS (SELECT *, mz - wa*ma - wb*mb - wc*mc AS w0 FROM (SELECT *, {', '.join(ws)} FROM s, q))"


_SPREADS = ", ".join(
    f"stddev_pop({c}) AS sd{i}, max({c}) - min({c}) AS mm{i}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS rb{i}" for i, c in enumerate(X))
_KINDS = {"standard": "sd", "minmax": "mm", "robust": "rb"}


@query("compare_models_gaps", _measured_sql(f"s AS ({_sums_sql('f', "side = 'train'")}), q AS (SELECT {_SPREADS} FROM f WHERE side = 'train'), {_solve_sql('lin', 's')}, "
       + ", ".join(_ridge_scaled_sql(k, [f"{p}{i}" for i in range(3)]) for k, p in _KINDS.items())
       + ", sol AS (SELECT 'linear' AS model, w0, wa, wb, wc FROM lin" + "".join(f" UNION ALL SELECT 'ridge {k}', w0, wa, wb, wc FROM {k}" for k in _KINDS) + ")"))
def compare_models_gaps(spark, sf):
    lines = gappy_lines(spark, sf)
    n = lines.where(F.col(Y).isNotNull() & (features.split_column("k") == "train")).count()
    configs = {"linear": RegressionConfig("linear")} | {f"ridge {k}": RegressionConfig("ridge", n / 2, scaling=k) for k in _KINDS}
    out = regression.compare_models(lines, Y, X, configs, "k").select("model", "train_r2", "test_r2", "test_mse", "best")
    return rounded(rounded(out, 1, "test_mse"), 4, "train_r2", "test_r2")


# --- clustering and classification --------------------------------------------------------------

RFM = ["total", "n_orders", "c_acctbal", "mean_price"]


@query("kmeans_segments")
def kmeans_segments(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("total"), F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"))
    df = per.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", *RFM)
    return clustering.segment_summary(clustering.segment(df, RFM), RFM)


def labelled_documents(spark, sf):
    t = F.col("text")
    docs = table(spark, sf, "documents").select(
        "doc_id", F.log1p(F.length(t)).alias("log_chars"), F.log1p(F.size(F.split(t, r"\s+"))).alias("log_words"),
        F.try_divide(F.length(F.regexp_replace(t, "[^0-9]+", "")), F.length(t)).alias("digit_share"),
        F.try_divide(F.length(F.regexp_replace(t, "[a-zA-Z\\s]+", "")), F.length(t)).alias("symbol_share"))
    return docs.join(table(spark, sf, "labels"), "doc_id")


@query("fit_mlp_classifier")
def fit_mlp_classifier(spark, sf):
    # Texts are read once: means, scaling, codes, training and scoring pass over the written figures, in the order of the join.
    path, rows = scratch_path(spark, "figures"), labelled_documents(spark, sf)
    rows.write.parquet(path)
    df = spark.read.schema(rows.schema).parquet(path)
    m = classification.fit_mlp(df, "quality", ["log_chars", "log_words", "digit_share", "symbol_share"], "simple", max_iter=60)
    scored = m.predict(df).select("doc_id", "quality", "prediction", "confidence")
    return scored.groupBy("quality", "prediction").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 2).alias("mean_confidence"))


@query("classification_accuracy", """SELECT count(*) AS n, round(avg(CASE WHEN quality = CASE WHEN n_chars > 400 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM labels JOIN documents USING (doc_id)""")
def classification_accuracy(spark, sf):
    df = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").withColumn("guess", (F.col("n_chars") > 400).cast("int"))
    return rounded(classification.accuracy(df, "quality", "guess"), 6)


# --- registry -----------------------------------------------------------------------------------


def _line_models(spark, sf):
    """One charge-by-price line per supplier, as model records."""
    per = charged_lines(spark, sf).groupBy("l_suppkey").agg(
        F.regr_r2("charge", "l_extendedprice").alias("r2"), F.regr_slope("charge", "l_extendedprice").alias("slope"))
    return per.select(
        F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("model_id"), F.concat(F.lit("line "), F.col("l_suppkey").cast("string")).alias("name"),
        F.lit("linear").alias("model_type"), F.lit("lineitem").alias("dataset_id"), F.lit("charge").alias("target"),
        F.create_map(F.lit("r2"), "r2", F.lit("slope"), "slope").alias("metrics"),
        F.create_map(F.lit("l_extendedprice"), F.lit(1.0)).alias("importance"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("l_suppkey") * 60).alias("created"))


def _registered(spark, sf):
    path = scratch_path(spark, "models")
    registry.register(_line_models(spark, sf), path)
    registry.deactivate(spark, path, F.element_at("metrics", F.lit("r2")) < 0.985)
    return path


MODELS_SQL = f"{LINES_SQL}, m AS (SELECT l_suppkey, regr_r2(charge, l_extendedprice) AS r2, regr_slope(charge, l_extendedprice) AS slope FROM line GROUP BY 1)"


@query("model_registry", f"""WITH {MODELS_SQL} SELECT 'm' || l_suppkey AS model_id, 'line ' || l_suppkey AS name, round(r2, 4) AS r2, CAST(0 AS BIGINT) AS version FROM m WHERE r2 >= 0.985""")
def model_registry(spark, sf):
    rows = registry.list_models(spark, _registered(spark, sf))
    return rows.select("model_id", "name", F.round(F.element_at("metrics", F.lit("r2")), 4).alias("r2"), "version")


@query("best_model_row", f"WITH {MODELS_SQL} SELECT 'm' || l_suppkey AS model_id, round(r2, 4) AS r2 FROM m ORDER BY m.r2 DESC, model_id LIMIT 1")
def best_model_row(spark, sf):
    rows = registry.list_models(spark, _registered(spark, sf)).withColumn("r2", F.element_at("metrics", F.lit("r2")))
    return rounded(regression.best_model(rows, "r2", "model_id").select("model_id", "r2"))


@query("export_model_report", f"""WITH {MODELS_SQL}, a AS (SELECT * FROM m WHERE r2 >= 0.985)
SELECT 'm' || l_suppkey AS model_id, 'performance' AS section, 'r2' AS item, round(r2, 4) AS value, 0 AS rank FROM a
UNION ALL SELECT 'm' || l_suppkey, 'performance', 'slope', round(slope, 4), 0 FROM a
UNION ALL SELECT 'm' || l_suppkey, 'importance', 'l_extendedprice', 1.0, 1 FROM a""")
def export_model_report(spark, sf):
    report = registry.model_report(registry.list_models(spark, _registered(spark, sf)))
    return report.where("section <> 'model'").withColumn("value", F.col("value").cast("double"))


# --- NaN is missing, and the path for large tables -------------------------------------------------


def _scaled_nan(spark, sf, kind):
    df = nan_orders(spark, sf).select("o_orderkey", "o_totalprice", "o_custkey")
    out = features.fit_scaler(df, ["o_totalprice", "o_custkey"], kind).apply(df).withColumn("o_totalprice", F.nanvl("o_totalprice", F.lit(None).cast("double")))
    return rounded(out, 4, "o_totalprice", "o_custkey")


@query("scale_standard_nan", ORACLES["scale_standard"])
def scale_standard_nan(spark, sf):
    return _scaled_nan(spark, sf, "standard")


@query("scale_minmax_nan", ORACLES["scale_minmax"])
def scale_minmax_nan(spark, sf):
    return _scaled_nan(spark, sf, "minmax")


@query("select_kbest_gaps", f"{_filled_sql()} " + union_sql([
    "SELECT * FROM (SELECT feature, round(r, 4) AS r, round(r * r / (1 - r * r) * (n - 2), 3) AS f_score FROM ("
    + union_sql([f"SELECT '{c}' AS feature, corr({c}, {Y}) AS r, count(*) AS n FROM f" for c in X])
    + ") ORDER BY r * r / (1 - r * r) * (n - 2) DESC, feature LIMIT 2)"]))
def select_kbest_gaps(spark, sf):
    return correlation.select_kbest(gappy_lines(spark, sf), X, Y, 2).withColumns({"r": F.round("r", 4), "f_score": F.round("f_score", 3)})


# --- the whole training flow ------------------------------------------------------------------------


def _plan():
    return training.TrainingPlan(Y, X, "k", RegressionConfig("ridge", 1.0))


_CV_TRAIN = _cv_sql(["1.0"]).replace("FROM f WHERE", "FROM t WHERE").replace("FROM f,", "FROM t,")
_METRICS = {
    "r2": "1 - avg(r*r) / var_pop(y)", "mse": "avg(r*r)", "mae": "avg(abs(r))", "rmse": "sqrt(avg(r*r))",
    "mape": "avg(CASE WHEN y <> 0 THEN abs(r / y) END)", "explained_variance": "1 - var_pop(r) / var_pop(y)",
    "adjusted_r2": "1 - avg(r*r) / var_pop(y) * ((SELECT count(*) FROM t) - 1) / ((SELECT count(*) FROM t) - 4)"}
TRAIN_SQL = f"""{_filled_sql("side = 'train'")}, t AS (SELECT * FROM f WHERE side = 'train'), s AS ({_sums_sql('t')}), {_solve_sql('sol', 's', '(1.0 / n)')},
cv AS ({_CV_TRAIN}), e AS (SELECT side, {Y} AS y, {Y} - w0 - wa*{X[0]} - wb*{X[1]} - wc*{X[2]} AS r FROM f, sol)
SELECT 'rows' AS section, 'train' AS item, CAST(count(*) AS DOUBLE) AS value FROM t UNION ALL SELECT 'parameters', 'alpha', 1.0 UNION ALL SELECT 'parameters', 'l1_ratio', 0.5
UNION ALL SELECT 'coefficient', feature, round(coefficient, 3) FROM ({_coef_rows('sol', 6)})
UNION ALL SELECT 'importance', feature, round(abs(coefficient) / sum(abs(coefficient)) OVER (), 3) FROM ({_coef_rows('sol', 9)}) WHERE feature <> '(intercept)'
UNION ALL SELECT 'cross_validation', 'fold ' || fold, round(r2, 3) FROM cv
""" + "".join(f"UNION ALL SELECT side, '{n}', round({m}, 3) FROM e GROUP BY side\n" for n, m in _METRICS.items())


@query("train_model_report", TRAIN_SQL)
def train_model_report(spark, sf):
    return rounded(training.train(gappy_lines(spark, sf), _plan()).report, 3, "value")


@query("predict_saved_model", f"""{_filled_sql("side = 'train'")}, s AS ({_sums_sql('f', "side = 'train'")}), {_solve_sql('sol', 's', '(1.0 / n)')}
SELECT k, round(w0 + wa*{X[0]} + wb*{X[1]} + wc*{X[2]}, 2) AS prediction FROM f, sol""")
def predict_saved_model(spark, sf):
    lines, records = gappy_lines(spark, sf), scratch_path(spark, "models")
    trained = training.train(lines, _plan())
    trained.save(scratch_path(spark, "artefact"), records, "m1", "charges", "lines", "owner", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return rounded(training.predict_saved(spark, records, "m1", lines.where(F.col(Y).isNotNull())).select("k", "prediction"), 2, "prediction")


@query("residual_histogram", f"""WITH {LINES_SQL}, r AS (SELECT {Y} - l_extendedprice AS v FROM line), b AS (SELECT min(v) AS lo, max(v) AS hi FROM r),
c AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / 30)) AS INTEGER), 29) AS bin, count(*) AS n FROM r, b GROUP BY 1)
SELECT round(lo + (hi - lo) / 30 * (g.bin + 0.5), 3) AS x, CAST(coalesce(n, 0) AS DOUBLE) AS y
FROM (SELECT unnest(range(30)) AS bin) g CROSS JOIN b LEFT JOIN c ON c.bin = g.bin""")
def residual_histogram(spark, sf):
    lines = keyed_lines(spark, sf).withColumn("residual", F.col(Y) - F.col("l_extendedprice"))
    return rounded(training.residual_charts(lines, "residual", "k").where("chart = 'histogram'").select("x", "y"), 3)


@query("residual_qq", f"""WITH {KEYED_SQL}, r AS (SELECT k, {Y} - l_extendedprice AS v FROM keyed)
SELECT count(*) AS n, round(sum(v), 2) AS total, round(min(v), 3) AS low, round(max(v), 3) AS high, true AS rises, true AS symmetric FROM r""")
def residual_qq(spark, sf):
    """What must hold for the points: every residual once, quantiles that rise with them and are symmetric around zero."""
    lines = keyed_lines(spark, sf).withColumn("residual", F.col(Y) - F.col("l_extendedprice"))
    q = training.residual_charts(lines, "residual", "k").where("chart = 'qq'")
    return q.agg(F.count("*").alias("n"), F.round(F.sum("y"), 2).alias("total"), F.round(F.min("y"), 3).alias("low"), F.round(F.max("y"), 3).alias("high"),
                 (F.abs(F.max_by("x", "y") - F.max("x")) < 1e-9).alias("rises"), (F.abs(F.min("x") + F.max("x")) < 1e-6).alias("symmetric"))


@query("kmeans_invariants", """WITH p AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT count(*) AS n, round(sum(total), 1) AS total, CAST(4 AS BIGINT) AS n_segments, true AS labels_rise FROM p JOIN customer ON o_custkey = c_custkey""")
def kmeans_invariants(spark, sf):
    """What must hold whatever the random start: all customers once, four segments, and numbers that rise with the mean total."""
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("total"), F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"))
    df = per.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", *RFM)
    parts = clustering.segment(df, RFM).groupBy("segment").agg(F.count("*").alias("n"), F.sum("total").alias("t"), F.avg("total").alias("m"))
    return parts.agg(F.sum("n").alias("n"), F.round(F.sum("t"), 1).alias("total"), F.count("*").alias("n_segments"),
                     (F.transform(F.array_sort(F.collect_list(F.struct("segment", "m"))), lambda x: x["m"]) == F.array_sort(F.collect_list("m"))).alias("labels_rise"))
