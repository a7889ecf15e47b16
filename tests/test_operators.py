import math
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablesmith.operators import audit, charts, cleaning, correlation, features, ordering, paging, profile, quality, regression, registry
from tablesmith.operators.regression import RegressionConfig
from tablesmith.sources import readers


def people(spark):
    return spark.createDataFrame(
        [(1, "a", 30, 50000), (2, None, 40, 60000), (3, "c", None, 70000), (4, "d", 20, 55000), (5, "a", 50, 65000)],
        "id int, name string, age int, salary int")


def test_profile_fixture(spark):
    df = people(spark)
    assert list(profile.profile_shape(df).first()) == [5, 4, 3, 1, 0]
    assert {r["column"]: r["n_missing"] for r in profile.missing_summary(df).collect()} == {"id": 0, "name": 1, "age": 1, "salary": 0}
    salary = profile.numeric_summary(df).where("column = 'salary'").first()
    assert (salary["mean"], salary["min"], salary["max"], salary["median"]) == (60000.0, 50000.0, 70000.0, 60000.0)
    top = profile.categorical_summary(df).where("rank = 1").first()
    assert (top["count"], top["unique"], top["value"], top["frequency"]) == (4, 3, "a", 2)


def test_empty_and_all_null(spark):
    nulls = spark.createDataFrame([(None,)] * 3, "x double")
    assert list(profile.missing_summary(nulls).first())[1:] == ["x", 3, 100.0] or profile.missing_summary(nulls).first()["missing_percent"] == 100.0
    assert profile.numeric_summary(nulls).count() == 0
    empty = nulls.where("false")
    assert profile.missing_summary(empty).first()["missing_percent"] is None
    assert profile.profile_shape(spark.createDataFrame([], "a int").drop("a")).first()["n_rows"] == 0
    assert [r["rule"] for r in quality.quality_report(empty).collect()] == ["no_rows", "single_column"]


def test_sparse_columns(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (None, 1.0), (None, None), (None, None)], "a int, b double")
    assert cleaning.drop_sparse_columns(df, 0.5).columns == ["b"]
    with pytest.raises(ValueError):
        cleaning.drop_sparse_columns(df.select("a"), 0.5)


def test_mode_takes_smallest_tie(spark):
    df = spark.createDataFrame([(2.0,), (1.0,), (2.0,), (1.0,), (None,)], "x double")
    assert cleaning.fill_values(df, "mode") == {"x": 1.0}


def test_correlation_edge_cases(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (4.0, 1.0, 5.0)], "a double, b double, c double")
    small = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.correlation_matrix(df).collect()}
    wide = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.correlation_matrix(df, direct=1).collect()}
    assert small["a", "c"] is None and small["c", "c"] is None
    assert small["a", "b"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4, 1])[0, 1])
    for k in small:
        assert wide[k] == (None if small[k] is None else pytest.approx(small[k]))


def test_running_totals_with_gaps(spark):
    df = spark.createDataFrame([(i, None if i < 30 or i % 3 else float(i)) for i in range(100)], "k int, v double").repartition(5)
    one, many = (
        {r["k"]: r["cumulative"] for r in charts.cumulative_sum(df, ["k"], "v", small=small).collect()} for small in (1000, 0))
    assert one == many and many[29] is None and many[31] == 30.0


def test_long_ids_stay_apart(spark):
    from tablesmith.sources import readers
    ids = ["1234567890123456789", "1234567890123456788", "-9223372036854775808"]
    df = readers._typed(spark.createDataFrame([(i,) for i in ids], "id string"))
    assert dict(df.dtypes)["id"] == "bigint" and sorted(str(r[0]) for r in df.collect()) == sorted(ids)


def test_perfect_feature_comes_first(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), 3.0 * i + 2) for i in range(20)], "a double, b double, y double")
    assert [r["feature"] for r in correlation.select_kbest(df, ["b", "a"], "y").collect()] == ["a", "b"]


@pytest.mark.parametrize("small", [10_000, 0])
def test_order_operators_agree_with_plain_loops(spark, small):
    rng = np.random.default_rng(1)
    # One group holds most rows and one order value a third of them.
    rows = [(i, "hot" if i % 5 else f"g{i % 3}", 7 if i % 3 == 0 else int(rng.integers(0, 50)), float(rng.integers(0, 100))) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, g string, o int, v double").repartition(5)
    expected = {}
    for g in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        total = 0.0
        for pos, r in enumerate(mine):
            total += r[3]
            last = [x[3] for x in mine[max(0, pos - 6): pos + 1]]
            expected[r[0]] = (pos, total, sum(last) / 7 if len(last) == 7 else None)
    out = ordering.with_position(df, ["o", "k"], ["g"], small=small)
    out = charts.cumulative_sum(out, ["o", "k"], "v", ["g"], small=small)
    out = charts.moving_average(out, ["o", "k"], "v", 7, ["g"], small=small, block=50)
    got = {r["k"]: (r["pos"], r["cumulative"], r["ma_7"]) for r in out.collect()}
    assert got.keys() == expected.keys()
    for k, (pos, total, mean) in expected.items():
        assert got[k][0] == pos and got[k][1] == pytest.approx(total)
        assert got[k][2] == (None if mean is None else pytest.approx(mean))


def test_qq_points_match_the_normal_quantiles(spark):
    values = [3.0, 1.0, 2.0, 5.0, 4.0, 2.0]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    n = len(values)
    p = [1 - 0.5 ** (1 / n), *[(i - 0.3175) / (n + 0.365) for i in range(2, n)], 0.5 ** (1 / n)]
    want = [statistics.NormalDist().inv_cdf(x) for x in p]
    got = [r["theoretical"] for r in charts.qq_points(df, "v", "k").orderBy("value", "k").collect()]
    assert got == pytest.approx(want, abs=1e-7)


def test_kde_integrates_to_about_one(spark):
    df = spark.createDataFrame([(float(x),) for x in np.random.default_rng(0).normal(0, 1, 500)], "v double")
    rows = charts.kde(df, "v").orderBy("point").collect()
    x, d = [r["x"] for r in rows], [r["density"] for r in rows]
    assert np.trapezoid(d, x) == pytest.approx(1, abs=0.05)


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 4, "v double")
    assert [r["n"] for r in charts.histogram(df, "v", 3).orderBy("bin").collect()] == [4, 0, 0]


def test_paging_is_disjoint_and_keyset_agrees(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(10)], "k int, o int")
    one, two = (paging.page(df, "o", "k", p, 3).collect() for p in (1, 2))
    assert len({r["k"] for r in one} | {r["k"] for r in two}) == 6 and one[0]["pages"] == 4 and one[0]["has_next"]
    after = paging.page(df, "o", "k", per_page=3, after=(one[-1]["o"], one[-1]["k"])).collect()
    assert [r["k"] for r in after] == [r["k"] for r in two]


def test_split_is_disjoint_exhaustive_and_repeatable(spark):
    df = spark.range(2000).toDF("k")
    train, test = features.split(df, "k")
    a, b = {r[0] for r in train.collect()}, {r[0] for r in test.collect()}
    assert not a & b and len(a | b) == 2000 and 330 < len(b) < 470
    assert b == {r[0] for r in features.split(df.repartition(7), "k")[1].collect()}


def regression_data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 3))
    y = 2 * x[:, 0] + 3 * x[:, 1] - 1.5 * x[:, 2] + rng.normal(0, 0.5, 300)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k int, a double, b double, c double, y double"), x, y


def test_models_against_closed_forms(spark, tmp_path):
    df, x, y = regression_data(spark)
    ones = np.column_stack([np.ones(300), x])
    want = np.linalg.lstsq(ones, y, rcond=None)[0]
    fitted = regression.fit(df, "y", ["a", "b", "c"])
    assert [fitted.intercept, *fitted.coefficients] == pytest.approx(list(want), rel=1e-6)
    for wide in (12, 1):
        w, b = regression.solve(regression.moments(df, ["a", "b", "c", "y"], direct=wide)[0], RegressionConfig())
        assert [b, *w] == pytest.approx(list(want), rel=1e-9)
    # MLlib minimises the same objective once its penalties are mapped: it divides the L2 term by the label's deviation.
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(df)
    sd, n = float(np.std(y)), len(y)
    for config, l1, l2 in ((RegressionConfig("ridge", 10.0), 0.0, 10.0 / n), (RegressionConfig("lasso", 0.3), 0.3, 0.0),
                           (RegressionConfig("elastic_net", 0.5, 0.3), 0.15, 0.35)):
        reg = l1 + l2 * sd
        ml = LinearRegression(featuresCol="x", labelCol="y", standardization=False, regParam=reg, elasticNetParam=l1 / reg, tol=1e-12).fit(data)
        mine = regression.fit(df, "y", ["a", "b", "c"], config)
        assert [mine.intercept, *mine.coefficients] == pytest.approx([ml.intercept, *ml.coefficients], abs=1e-6)
    scored = fitted.predict(df.withColumn("a", F.when(F.col("k") > 5, F.col("a"))))
    assert scored.where("prediction IS NULL").count() == 0
    assert regression.regression_metrics(fitted.predict(df), "y", "prediction", 300, 3).first()["r2"] > 0.9
    path = registry.save_model(fitted.model, str(tmp_path / "m"))
    again = regression.predict(registry.load_model(path), df, ["a", "b", "c"])
    assert again.select(F.sum("prediction")).first()[0] == pytest.approx(fitted.predict(df).select(F.sum("prediction")).first()[0])


def test_bad_model_requests(spark):
    df, _, _ = regression_data(spark)
    with pytest.raises(ValueError):
        RegressionConfig("forest")
    with pytest.raises(ValueError):
        regression.fit(df.where("false"), "y", ["a"])
    with pytest.raises(ValueError):
        regression.fit(df, "y", ["nope"])
    scored, status = regression.predict_many(regression.fit(df, "y", ["a"]).model, {"good": df, "bad": df.drop("a")}, ["a"])
    assert scored.count() == 300 and {r["dataset_id"]: r["status"] for r in status.collect()} == {"good": "success", "bad": "error"}


def test_rfe_and_kbest(spark):
    df, _, _ = regression_data(spark)
    assert {r["feature"]: r["rank"] for r in regression.select_rfe(df, ["a", "b", "c"], "y", 1).collect()} == {"b": 1, "a": 2, "c": 3}
    assert [r["feature"] for r in correlation.select_kbest(df, ["a", "b", "c"], "y", 2).collect()] == ["b", "a"]


def test_severity_table(spark):
    cases = [("critical", "success", "malware_detected", "CRITICAL"), ("low", "failure", "login_failed", "ERROR"),
             ("medium", "failure", "rate_limit_exceeded", "WARNING"), ("low", "success", "data_accessed", "INFO")]
    df = spark.createDataFrame([c[:3] for c in cases], "r string, o string, t string")
    assert [r[0] for r in df.select(audit.severity(F.col("r"), F.col("o"), F.col("t"))).collect()] == [c[3] for c in cases]


def test_delimiters_and_missing_texts(spark, tmp_path):
    assert readers.pick_delimiter(["a;b;c", "1;2;3", "4;5;6"]) == ";"
    assert readers.pick_delimiter(["a,b", "1,2,3"]) == ","
    assert readers.pick_delimiter(["only"]) == ","
    f = tmp_path / "t.csv"
    f.write_text('id, score ,flag,club\n1,2.5,True,None\n2,NA,False,chess\n3,1e3,True,"a ""b"""\n')
    df = readers.load(spark, str(f))
    assert df.dtypes == [("id", "bigint"), ("score", "double"), ("flag", "boolean"), ("club", "string")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 2.5, True, None), (2, None, False, "chess"), (3, 1000.0, True, 'a "b"')]
    with pytest.raises(ValueError):
        readers.load(spark, "x.xlsx")


def test_json_arrays_over_lines(spark, tmp_path):
    f = tmp_path / "r.json"
    f.write_text('[\n {"a": 1},\n {"a": 2}\n]\n')
    assert sorted(r["a"] for r in readers.read_json(spark, str(f)).collect()) == [1, 2]


def test_registry_newest_version_counts(spark, tmp_path):
    path = str(tmp_path / "reg")
    registry.register(spark.createDataFrame([("m1", "a"), ("m2", "b")], "model_id string, name string"), path)
    registry.deactivate(spark, path, F.col("model_id") == "m1")
    assert [r["model_id"] for r in registry.list_models(spark, path).collect()] == ["m2"]
    assert registry.model_info(spark, path, "m1").first()["is_active"] is False


def test_outlier_removal_keeps_nulls_and_recomputes(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (2.0, None), (100.0, 2.0), (2.5, 50.0)], "a double, b double")
    left = sorted((r["a"], r["b"]) for r in cleaning.remove_outliers(df).collect() if r["b"] is not None)
    assert left == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)] and cleaning.remove_outliers(df).where("b IS NULL").count() == 1
    assert not math.isnan(left[0][0])


def test_classifier_reads_texts_once(spark, sf, monkeypatch):
    from pyspark.sql import functions as F

    from tablesmith.plans import modelling

    met, plain = spark.sparkContext.accumulator(0), modelling.labelled_documents

    @F.udf("long")
    def seen(k):
        met.add(1)
        return k

    monkeypatch.setattr(modelling, "labelled_documents", lambda *a: plain(*a).withColumn("doc_id", seen.asNondeterministic()("doc_id")))
    rows = modelling.fit_mlp_classifier(spark, sf).collect()
    assert met.value == sum(r.n for r in rows) == plain(spark, sf).count()
