"""Notebook path (F1): raw sales / traffic / stock / holiday tables -> the
monthly per-product feature table, as one lazy plan (plus the median passes
of the final fills, which read a checkpoint of the pre-fill table).

Shuffles: sales -> (month, product) partial aggregate; traffic -> month
aggregate (one row per month); one range shuffle for the allocation's ranks;
joins to product info and stock at product grain; one product window for all
the time-series features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.functions.calendar import month_text
from retailcast.functions.text import parse_weight
from retailcast.operators.allocate import allocate_traffic
from retailcast.operators.clean import prepare_sales
from retailcast.operators.features import (advanced_features, basic_features, encode_labels,
                                           time_series_features)
from retailcast.operators.finalize import finalize_features, numeric_columns
from retailcast.operators.joins import holiday_month_flag, sales_product_info_join, sales_stock_join
from retailcast.session import cut_lineage
from retailcast.operators.rollup import (TrafficSpec, monthly_sales_with_first, monthly_traffic,
                                         product_info_from_monthly)

INFO_COLUMNS = ["seller_voucher", "platform_voucher", "coin_discount", "shipping_fee", "shipping_deduction",
                "return_shipping", "total_payment", "estimated_shipping", "status", "list_price",
                "weight_text", "total_weight_text"]
SOURCE_ORDER = ["src_orderkey", "src_linenumber", "src_partkey", "src_suppkey", "list_price"]
STOCK_NUMBERS = ["product_id", "opening_stock", "closing_stock", "pending"]


def joined_monthly(sales: DataFrame, traffic: DataFrame, stock_status: DataFrame,
                   holidays: DataFrame | None, *, spec: TrafficSpec | None = None,
                   cutoff: str | None = None, info_cols=INFO_COLUMNS,
                   order_cols=SOURCE_ORDER) -> DataFrame:
    """Steps 2-9: clean, roll up, allocate traffic, join product info, stock
    status and holiday months, parse weights, encode the stock status."""
    absent = [c for c in info_cols if c not in sales.columns]
    sales = sales.withColumns({c: F.lit(None).cast("string" if c.endswith("_text") else "double") for c in absent})
    s = prepare_sales(sales, holidays)
    # One hash aggregate over the order lines, materialised (reliable
    # checkpoint): later steps run as several jobs, and none of them may roll
    # up the lines again. The first row of each product is fetched apart.
    agg = cut_lineage(monthly_sales_with_first(s, order_by=order_cols[0]))
    monthly = agg.where(F.col("month").isNotNull()).drop("first_order")
    alloc = allocate_traffic(monthly, monthly_traffic(traffic, spec), spec, cutoff)
    info = product_info_from_monthly(agg, s, list(info_cols), list(order_cols))
    j = sales_product_info_join(alloc, info)
    j = sales_stock_join(j, stock_status, STOCK_NUMBERS + ["stock_status"])
    # NULL for products without stock rows: float columns, as after the source's join
    j = j.withColumns({c: F.col(c).cast("double") for c in STOCK_NUMBERS})
    j = holiday_month_flag(j, holidays)
    j = (j.withColumns({"weight": parse_weight(F.col("weight_text")),
                        "total_weight": parse_weight(F.col("total_weight_text"))})
          .drop("weight_text", "total_weight_text"))
    return encode_labels(j, "stock_status", "stock_status_code")


def features_unfilled(joined: DataFrame) -> DataFrame:
    """Steps 10-12: calendar, growth, seasonality, ratios, rolling, lags."""
    return time_series_features(advanced_features(basic_features(joined)))


def feature_table(sales: DataFrame, traffic: DataFrame, stock_status: DataFrame,
                  holidays: DataFrame | None, *, spec: TrafficSpec | None = None,
                  cutoff: str | None = None, finalize: bool = True, order_cols=SOURCE_ORDER) -> DataFrame:
    """The full table (step 13 included unless ``finalize=False``). Month is
    returned as 'yyyy-MM' text, plus ``date_index`` (same text); the order
    status column is dropped, as in the source."""
    f = features_unfilled(joined_monthly(sales, traffic, stock_status, holidays, spec=spec, cutoff=cutoff,
                                         order_cols=order_cols))
    if finalize:
        # identifiers are no quantities: no median, no zero
        f = finalize_features(f, median_cols=numeric_columns(f, exclude=("product_id",)))
    f = f.withColumns({"date_index": month_text(F.col("month")), "month": month_text(F.col("month"))})
    return f.drop("status")
