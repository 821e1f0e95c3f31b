"""Lenient path: any sales / traffic / stock / holiday tables whose headers
are found through the alias lists -> monthly rows (J7) -> model features (F2).

Differences from the notebook path are deliberate options of the same
operators: lenient product key, month as 'yyyy-MM' text, traffic as plain
monthly totals joined on month, the stock table joined whole (so the target
is the stock table's sold quantity), constant seasonal index and order
feature, and its own fill rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.functions import sqltext as X
from retailcast.functions.calendar import month_from_text
from retailcast.functions.keys import product_key_lenient
from retailcast.operators.joins import holiday_month_flag, safe_join
from retailcast.operators.rollup import monthly_rollup
from retailcast.sources.schema import parse_dates, resolve_columns

# The nine model features, in the order the model uses them.
MODEL_FEATURES = [
    "rolling_3m_qty",
    "mean_qty_per_product",
    "lag_1_qty",
    "seasonal_index",
    "trend_qty",
    "lag_2_qty",
    "mom_growth_qty",
    "lag_3_qty",
    "total_orders",
]
# Target column candidates, in priority order.
TARGET_CANDIDATES = ["sold_qty", "qty", "quantity", "sales"]


def core_assembly(sales: DataFrame, traffic: DataFrame, stock_status: DataFrame,
                  holidays: DataFrame | None) -> DataFrame:
    """Resolve headers, parse dates, lenient keys, monthly roll-ups,
    then sales LEFT JOIN traffic on month, LEFT JOIN stock on (month, product),
    plus the holiday-month flag. Month is 'yyyy-MM' text."""
    sc = resolve_columns(sales, "sales")
    tc = resolve_columns(traffic, "traffic")
    stc = resolve_columns(stock_status, "stock_status")
    hc = resolve_columns(holidays, "holidays") if holidays is not None else {"date": None}

    sales = parse_dates(sales, sc["date"]) if sc["date"] else sales
    variant = F.col(sc["variant"]) if sc["variant"] else None
    sales = sales.withColumn("product_key", product_key_lenient(F.col(sc["product"]), variant))
    aggs = {c: "sum" for c in (sc["quantity"], sc["price"]) if c}
    sales_m = (monthly_rollup(sales, sc["date"], ["product_key"], aggs) if aggs
               else monthly_rollup(sales, sc["date"], ["product_key"], {"*": "size"}))

    traffic = parse_dates(traffic, tc["date"]) if tc["date"] else traffic
    t_aggs = {tc["quantity"]: "sum"} if tc["quantity"] else {"*": "size"}
    traffic_m = monthly_rollup(traffic, tc["date"], [], t_aggs)
    main = safe_join(sales_m, traffic_m, ["month"], "left")

    if stc["product"] and stc["month"]:
        st = stock_status.withColumnsRenamed({stc["product"]: "product_key", stc["month"]: "month"})
        main = safe_join(main, st, ["month", "product_key"], "left")

    if holidays is not None and hc["date"]:
        h = parse_dates(holidays, hc["date"]).withColumn("holiday_date", F.to_date(F.col(hc["date"])))
        return holiday_month_flag(main, h, month_col="month")
    return main.withColumn("is_holiday_month", F.lit(False))


def core_features(df: DataFrame, key: str = "product_key", month: str = "month") -> DataFrame:
    """target, 3 lags, 3-row rolling mean, product mean, growth, constant
    seasonal index 1.0, trend ratio, constant order feature 1.0; lags,
    growth and trend NULL -> 0 and the trend's infinities -> 0."""
    target = next((c for c in TARGET_CANDIDATES if c in df.columns), None)
    t = X.q(target) if target else "CAST(1 AS BIGINT)"
    df = df.selectExpr("*", f"{t} AS total_qty")
    if dict(df.dtypes)[month] == "string":
        df = df.withColumn("__month_date", month_from_text(F.col(month)))
    else:
        df = df.withColumn("__month_date", F.col(month))
    wp = X.window([key], ["`__month_date`"])
    r3 = X.window([key], ["`__month_date`"], "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW")
    ff = X.window([key], ["`__month_date`"], "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    df = df.selectExpr(
        "*",
        "CAST(month(`__month_date`) AS BIGINT) AS month_of_year",
        *[f"CAST(coalesce(lag(total_qty, {k}) OVER {wp}, 0) AS DOUBLE) AS lag_{k}_qty" for k in (1, 2, 3)],
        f"avg(total_qty) OVER {r3} AS rolling_3m_qty",
        f"avg(total_qty) OVER {X.window([key])} AS mean_qty_per_product",
        f"last(total_qty, true) OVER {ff} AS `__ffill`",
        "CAST(1.0 AS DOUBLE) AS seasonal_index",
        "CAST(1.0 AS DOUBLE) AS total_orders")
    df = df.selectExpr(
        "*",
        f"coalesce({X.ieee('`__ffill`', f'lag(`__ffill`) OVER {wp}')} - 1.0, 0.0) AS mom_growth_qty",
        f"{X.ieee('total_qty', f'lag(rolling_3m_qty) OVER {wp}')} AS `__trend`")
    df = df.selectExpr("*", "CASE WHEN `__trend` IS NULL OR abs(`__trend`) = CAST('Infinity' AS DOUBLE) "
                            "THEN 0.0 ELSE `__trend` END AS trend_qty")
    return df.drop("__month_date", "__ffill", "__trend")


def training_rows(features: DataFrame, feature_cols=MODEL_FEATURES, target: str = "total_qty") -> DataFrame:
    """Rows whose features and target are all present."""
    return features.dropna(subset=list(feature_cols) + [target])
