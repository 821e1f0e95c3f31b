"""Window features on hand-written series: growth from 0, gaps, short series,
and the ordered fill rules."""

import math

from pyspark.sql import functions as F

from retailcast.operators.features import linear_trend_last3
from retailcast.operators.finalize import finalize_features
from retailcast.plans.core_table import core_features


def test_core_features_edges(spark):
    rows = [("a", "2024-01", 0), ("a", "2024-02", 5), ("a", "2024-04", 5),  # growth from 0, a month gap
            ("b", "2024-01", 0), ("b", "2024-02", 0),                       # 0 -> 0
            ("c", "2024-03", 4)]                                            # single month
    df = spark.createDataFrame(rows, "product_key string, month string, sold_qty long")
    out = {(r.product_key, r.month): r for r in core_features(df).collect()}
    a2 = out[("a", "2024-02")]
    assert a2.mom_growth_qty == math.inf          # 5 / 0 - 1
    assert a2.lag_1_qty == 0.0 and a2.trend_qty == 0.0  # 5 / previous rolling 0 -> inf -> 0
    a4 = out[("a", "2024-04")]
    assert a4.lag_1_qty == 5.0 and a4.lag_2_qty == 0.0  # previous *row*, not previous month
    assert a4.mom_growth_qty == 0.0
    assert out[("b", "2024-02")].mom_growth_qty == 0.0  # 0/0 -> missing -> 0
    c = out[("c", "2024-03")]
    assert c.lag_1_qty == 0.0 and c.rolling_3m_qty == 4.0 and c.mean_qty_per_product == 4.0


def test_linear_trend_closed_form(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 4.0],), ([5.0, 1.0, 2.0, 9.0],), ([9.0, 5.0, 1.0],)], "h array<double>")
    got = [r[0] for r in df.select(linear_trend_last3(F.col("h"))).collect()]
    assert got == [0.0, 3.0, 4.0, 0.0]


def test_fill_order(spark):
    rows = [(1, None, 1.0, 10.0), (2, 1.0, math.inf, None), (3, math.inf, None, 30.0), (4, 2.0, 2.0, None)]
    df = spark.createDataFrame(rows, "id long, trend_qty double, stock_coverage double, orders_rate double")
    out = {r.id: r for r in finalize_features(df, trend_cols=["trend_qty"], ratio_cols=["stock_coverage"]).collect()}
    # (a) trend NULL -> 0; infinities survive (a) and become the (d) median of {0, 1, 2}
    assert out[1].trend_qty == 0.0 and out[3].trend_qty == 1.0
    # (b) ratio NULL -> median of {1, inf, 2} = 2; then (c) inf -> NULL -> (d) median of {1, 2, 2}
    assert out[3].stock_coverage == 2.0 and out[2].stock_coverage == 2.0
    # (d) other numerics: NULL -> median of {10, 30}
    assert out[2].orders_rate == 20.0 and out[4].orders_rate == 20.0


def test_seasonal_profile_rules(spark):
    import datetime as dt

    from retailcast.operators.features import seasonal_profile
    rows = [("a", dt.date(2024, 1, 1), 2), ("a", dt.date(2025, 1, 1), 4), ("a", dt.date(2024, 3, 1), 6),
            ("z", dt.date(2024, 5, 1), 0)]
    df = spark.createDataFrame(rows, "product_key string, month date, qty long")
    prof = {r.product_key: r.seasonal for r in seasonal_profile(df).collect()}
    assert prof["a"][0] == 3.0 / 4.0 and prof["a"][2] == 6.0 / 4.0   # month mean / overall mean
    assert prof["a"][1] == 1.0 and len(prof["a"]) == 12                # month without data -> 1.0
    assert prof["z"] == [1.0] * 12                                     # overall mean <= 0 -> 1.0
