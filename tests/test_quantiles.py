import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.operators.quantiles import exact_quantiles, quantile_values

PROBS = [0.0, 0.25, 0.5, 0.99, 1.0]


def _frame(spark, values, groups=None):
    groups = groups or ["g"] * len(values)
    return spark.createDataFrame([(g, None if v is None else float(v)) for g, v in zip(groups, values)], "g string, v double").repartition(4)


@pytest.mark.parametrize("shape", ["ties", "lognormal", "huge_range", "single", "negative_int"])
def test_matches_numpy(spark, shape):
    rng = np.random.default_rng(3)
    values = {
        "normal": rng.normal(0, 1, 3000),
        "ties": np.r_[np.full(1500, 7.25), rng.normal(7, 1, 1500)],
        "lognormal": rng.lognormal(0, 8, 3000),
        "huge_range": np.r_[rng.normal(0, 1, 2000), 1e308, -1e308],
        "two_values": np.r_[np.zeros(10), np.ones(2)],
        "single": np.array([5.0]),
        "negative_int": rng.integers(-50, 5, 2500),
    }[shape]
    got = quantile_values(_frame(spark, list(values)), ["v"], PROBS, small_group=0, gather_rows=60, bins=256)["v"]
    assert got == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-12)


def test_groups_nulls_and_small_path_agree(spark):
    rng = np.random.default_rng(4)
    values = [None if i % 17 == 0 else v for i, v in enumerate(rng.normal(10, 5, 4000))]
    groups = ["hot" if i % 3 else f"g{i % 10}" for i in range(4000)]
    df = _frame(spark, values, groups)
    rows = lambda **kw: {(r["g"]): (r["n"], list(r["q"])) for r in exact_quantiles(df, ["v"], PROBS, by=["g"], **kw).collect()}
    big, small = rows(small_group=0, gather_rows=200, bins=128), rows()
    assert big.keys() == small.keys()
    for g in big:
        assert big[g][0] == small[g][0]
        assert big[g][1] == pytest.approx(small[g][1], rel=1e-12)


def test_empty_column_is_absent(spark):
    df = _frame(spark, [None, None]).withColumn("w", F.lit(1.0))
    assert quantile_values(df, ["v", "w"], [0.5]) == {"w": [1.0]}


def test_approx_is_close(spark):
    df = _frame(spark, range(10001))
    assert quantile_values(df, ["v"], [0.5], approx=True)["v"][0] == pytest.approx(5000, abs=5)


def test_infinities_count_as_the_largest_double(spark):
    df = _frame(spark, [float("inf"), float("-inf"), float("nan"), *range(200)])
    for kw in ({}, {"small_group": 0, "gather_rows": 50, "bins": 64}):
        assert quantile_values(df, ["v"], [0.5], **kw)["v"] == [99.5]
    rows = exact_quantiles(df, ["v"], [0.5], by=["g"], small_group=0, gather_rows=50, bins=64).collect()
    assert rows[0]["q"] == [99.5] and rows[0]["n"] == 202
