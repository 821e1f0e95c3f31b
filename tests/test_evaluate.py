"""Metrics and feature ranking against direct computation."""

import math

from retailcast.operators.evaluate import feature_correlation, regression_metrics


def test_regression_metrics(spark):
    pairs = [(1.0, 2.0), (0.0, 1.0), (4.0, 4.0), (float("nan"), 1.0), (2.0, float("inf")), (None, 3.0), (3.0, 1.0)]
    df = spark.createDataFrame(pairs, "y double, p double")
    r = regression_metrics(df, "y", "p").collect()[0]
    ok = [(1.0, 2.0), (0.0, 1.0), (4.0, 4.0), (3.0, 1.0)]
    n = len(ok)
    mae = sum(abs(y - p) for y, p in ok) / n
    rmse = math.sqrt(sum((y - p) ** 2 for y, p in ok) / n)
    nz = [(y, p) for y, p in ok if y != 0]
    mape = sum(abs((y - p) / y) for y, p in nz) / len(nz) * 100
    mean = sum(y for y, _ in ok) / n
    r2 = 1 - sum((y - p) ** 2 for y, p in ok) / sum((y - mean) ** 2 for y, _ in ok)
    assert r.valid_samples == n
    assert math.isclose(r.mae, mae) and math.isclose(r.rmse, rmse) and math.isclose(r.mape, mape)
    assert math.isclose(r.r2, r2)
    const = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert regression_metrics(const, "y", "p").collect()[0].r2 == 1.0
    assert regression_metrics(spark.createDataFrame([(None, 1.0)], "y double, p double"), "y", "p").count() == 0


def test_feature_correlation(spark):
    rows = [(float(i), float(2 * i + 1), 1.0, float(-i)) for i in range(10)]
    df = spark.createDataFrame(rows, "y double, up double, flat double, down double")
    got = [(r.feature, r.correlation, r.rank) for r in feature_correlation(df, ["flat", "down", "up"], "y").collect()]
    by = {f: (c, k) for f, c, k in got}
    assert math.isclose(by["up"][0], 1.0) and math.isclose(by["down"][0], -1.0) and by["flat"][0] is None
    assert by["up"][1] == 1 and by["down"][1] == 2 and by["flat"][1] == 3
