"""Per-product time-series features over (product, month) rows.

Windows are row-based: lag, rolling and pct-change look at the previous
*existing* row of the product, not the previous calendar month. All product
windows share ``partitionBy(product_key)``, so Spark plans one shuffle on the
key and reuses it (the (product, month-of-year) window is clustered by the
same hash partitioning and only adds a sort).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailcast.functions import sqltext as X

KEY = "product_key"
MONTH = "month"


def seasonal_profile(monthly: DataFrame, col: str = "qty", key: str = KEY, month: str = MONTH) -> DataFrame:
    """Full 12-month seasonal map per product as an array (index m-1):
    month mean / overall mean; a month without data, or overall mean <= 0,
    gives 1.0. A grouped aggregate, no cross join of products x months."""
    by_moy = (monthly.groupBy(key, F.month(month).alias("moy"))
              .agg(F.sum(col).alias("s"), F.count(col).alias("c")))
    per = (by_moy.groupBy(key)
           .agg(F.map_from_entries(F.collect_list(F.struct("moy", (F.col("s") / F.col("c")).alias("m"))))
                .alias("mm"),
                (F.sum("s") / F.sum("c")).alias("overall")))
    months = F.sequence(F.lit(1), F.lit(12))
    prof = F.transform(months, lambda m: F.when((F.col("overall") > 0) & F.element_at("mm", m).isNotNull()
                                                 & ~F.isnan(F.element_at("mm", m)),
                                                 F.element_at("mm", m) / F.col("overall")).otherwise(F.lit(1.0)))
    return per.select(key, prof.alias("seasonal"))


def encode_labels(df: DataFrame, col: str, out: str, missing: str = "Unknown") -> DataFrame:
    """Label -> code, alphabetical from 0 (missing -> ``missing`` first).

    The vocabulary is one sorted array (a status column has a handful of
    labels), gathered by a partial aggregate and read as a scalar: a code is a
    position in it, with neither a join nor a window."""
    filled = df.withColumn(col, F.coalesce(F.col(col), F.lit(missing)))
    vocabulary = filled.agg(F.sort_array(F.collect_set(col)).alias("v")).scalar()
    return filled.withColumn(out, (F.array_position(vocabulary, F.col(col)) - 1).cast("long"))


_WP = X.window([KEY], [X.q(MONTH)])
_R3 = X.window([KEY], [X.q(MONTH)], "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW")
_WK = X.window([KEY])


def _lag(c: str, k: int = 1) -> str:
    return f"lag({X.q(c)}, {k}) OVER {_WP}"


def basic_features(df: DataFrame) -> DataFrame:
    """Calendar parts and the rounded per-product mean quantity."""
    return df.selectExpr(
        "*",
        "CAST(year(`month`) AS BIGINT) AS year",
        "CAST(month(`month`) AS BIGINT) AS month_of_year",
        "CAST(quarter(`month`) AS BIGINT) AS quarter",
        "CAST(dayofmonth(last_day(`month`)) AS BIGINT) AS days_in_month",
        f"CAST(bround(avg(qty) OVER {_WK}, 0) AS BIGINT) AS mean_qty_per_product")


def advanced_features(df: DataFrame) -> DataFrame:
    """Growth, seasonality, price level, stock ratios, traffic ratios."""
    overall = f"avg(qty) OVER {_WK}"
    by_moy = f"avg(qty) OVER {X.window([KEY, 'month_of_year'])}"
    return df.selectExpr(
        "*",
        f"{X.ieee('qty', _lag('qty'))} - 1.0 AS mom_growth_qty",
        f"{X.ieee('sales_amount', _lag('sales_amount'))} - 1.0 AS mom_growth_sales",
        f"CASE WHEN {overall} > 0 THEN {by_moy} / {overall} ELSE 0.0 END AS seasonal_index",
        f"{X.ieee('list_price', f'avg(list_price) OVER {_WK}')} AS price_level",
        f"{X.ieee('qty', '(opening_stock + closing_stock) / 2.0')} AS stock_turnover",
        f"{X.ieee('closing_stock', f'avg(qty) OVER {_R3}')} AS stock_coverage",
        f"views / {X.zero_to_one('qty')} AS view_to_sales_ratio",
        f"visitors / {X.zero_to_one('qty')} AS visitor_to_sales_ratio",
        f"visitors / {X.zero_to_one('views')} AS visitor_to_view_ratio")


def time_series_features(df: DataFrame) -> DataFrame:
    """Rolling means, trend, quarter flags, lags 1-3, cyclic month, interactions."""
    df = df.selectExpr("*", f"avg(qty) OVER {_R3} AS rolling_3m_qty",
                       f"avg(sales_amount) OVER {_R3} AS rolling_3m_sales",
                       f"avg(views) OVER {_R3} AS rolling_3m_views")
    exprs = [f"{X.ieee('qty', _lag('rolling_3m_qty'))} AS trend_qty"]
    exprs += [f"quarter = {q} AS quarter_{q}" for q in (1, 2, 3, 4)]
    for k in (1, 2, 3):
        exprs += [f"coalesce({_lag('qty', k)}, 0) AS lag_{k}_qty",
                  f"coalesce({_lag('sales_amount', k)}, 0) AS lag_{k}_sales",
                  f"coalesce({_lag('views', k)}, 0) AS lag_{k}_views",
                  f"CAST(coalesce({_lag('stock_turnover', k)}, 0) AS DOUBLE) AS lag_{k}_stock_turnover"]
    two_pi = repr(2 * math.pi)
    exprs += [f"sin({two_pi} * month_of_year / 12.0) AS month_sin",
              f"cos({two_pi} * month_of_year / 12.0) AS month_cos",
              f"{X.nan_null('price_level * views')} AS price_view_interaction",
              f"{X.nan_null('stock_coverage * visitors')} AS stock_demand_interaction"]
    return df.selectExpr("*", *exprs)


def linear_trend_last3(hist: Column) -> Column:
    """Slope of a least-squares line through the last (up to) 3 values of an
    array, floored at 0; fewer than 2 values -> 0. Closed form: 3 values
    (y3 - y1) / 2, 2 values y2 - y1."""
    n = F.size(hist)
    y = lambda i: F.element_at(hist, i)  # noqa: E731 - negative index from the end
    slope = (F.when(n >= 3, (y(-1) - y(-3)) / F.lit(2.0))
             .when(n == 2, (y(-1) - y(-2)).cast("double"))
             .otherwise(F.lit(0.0)))
    return F.greatest(F.lit(0.0), slope)
