"""Registered queries: name -> (spark, sf_dir) -> DataFrame, each over the
whole test tables. ``retailcast.oracle`` holds the matching DuckDB SQL.

Double outputs that depend on summation order are rounded to 6 places here
(and in the SQL), so both engines print the same digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.operators.clean import prepare_sales
from retailcast.operators.rollup import monthly_product_sales
from retailcast.sources.fixtures import STOCK_DROP_MONTH, TRAFFIC_START, Fixtures
from retailcast.operators.allocate import allocate_traffic, apportion_counts, month_share
from retailcast.operators.rollup import TrafficSpec, monthly_traffic, traffic_ratios_global
from retailcast.plans.feature_table import feature_table, features_unfilled, joined_monthly
from retailcast.plans.core_table import MODEL_FEATURES, core_assembly, core_features, training_rows
from retailcast.plans.forecast import (DEFAULT_LINEAR, LinearScorer, forecast_growth, forecast_recursive,
                                       future_months, history_and_forecast)
from retailcast.functions.calendar import month_from_text
from pyspark.sql import Window
from retailcast.functions import sqltext as X
from retailcast.functions.calendar import month_text
from retailcast.functions.numeric import ieee_div
from retailcast.functions.text import parse_localized_number, parse_percent, parse_weight
from retailcast.operators.clean import (discount_pct, drop_cancelled, scaled_amount, unit_price,
                                        with_order_month, with_product_key)
from retailcast.operators.compare import compare_nulls, compare_shape, compare_values, compare_verdict
from retailcast.operators.evaluate import feature_correlation, regression_metrics
from retailcast.operators.features import (advanced_features, basic_features, encode_labels,
                                           linear_trend_last3, seasonal_profile, time_series_features)
from retailcast.operators.joins import (holiday_month_flag, safe_join, sales_product_info_join,
                                        sales_stock_join, sales_traffic_join)
from retailcast.operators.medians import column_medians_frame, grouped_medians
from retailcast.operators.rollup import (dataset_summary, forecast_totals, monthly_rollup,
                                         monthly_row_counts, product_info_first, product_list, top_products)
from retailcast.plans.feature_table import INFO_COLUMNS, SOURCE_ORDER
from retailcast.plans.boosting import BoostSettings, Ensemble, grid_search as boosted_grid, train_boosted
from retailcast.plans.train import gbt_metrics, score, train_gbt, train_test_split
from retailcast.session import cut_lineage, scratch_path
from retailcast.sources.folders import read_role_folder
from retailcast.sources.readers import read_table
from retailcast.sources.schema import (date_parse_rates, drop_if_present, ensure_column, parse_dates, rename_columns,
                                         resolve_columns)
from retailcast.sources.sinks import export_forecasts, write_table
from retailcast.sources.tables import SOURCE_TABLES, read_source_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def sx(df: DataFrame, *exprs: str) -> DataFrame:
    """selectExpr with two-argument round() made engine-independent."""
    from retailcast.functions.sqltext import fix_round
    return df.selectExpr(*[fix_round(e) for e in exprs])


def r6(c):
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") * 1e6) / 1e6


def _fx(spark, sf) -> Fixtures:
    return Fixtures(spark, sf)


@query("monthly_product_sales")
def q_monthly_product_sales(spark, sf):
    return monthly_product_sales(prepare_sales(_fx(spark, sf).sales()))


# --- allocation ------------------------------------------------------------

_SPEC = TrafficSpec()
COUNTS = list(_SPEC.counts)
MONEY = list(_SPEC.money)
RATES = list(_SPEC.rate_text)


def _monthly(spark, sf):
    return monthly_product_sales(prepare_sales(_fx(spark, sf).sales()))


def _traffic_m(spark, sf):
    # without the first months: what the estimate and the unmatched rows of the joins are for
    return monthly_traffic(_fx(spark, sf).traffic(TRAFFIC_START))


def _all_traffic_m(spark, sf):
    return monthly_traffic(_fx(spark, sf).traffic())


def _stock(spark, sf):
    return _fx(spark, sf).stock_status(STOCK_DROP_MONTH)   # one month without rows: unmatched rows in the joins


@query("monthly_traffic")
def q_monthly_traffic(spark, sf):
    t = _all_traffic_m(spark, sf)
    return t.select("month", r6("total_sales").alias("total_sales"), *COUNTS,
                    *[r6(c).alias(c) for c in MONEY + ["sales_per_order"] + RATES])


@query("traffic_ratios_global")
def q_traffic_ratios_global(spark, sf):
    g = traffic_ratios_global(_all_traffic_m(spark, sf))
    return g.select(*[(F.round(F.col(c) * 1e9) / 1e9).alias(c) for c in g.columns])


@query("month_share")
def q_month_share(spark, sf):
    m = month_share(_monthly(spark, sf))
    return m.select("month", "product_key", "net_amount", r6("weight").alias("weight"))


def _alloc_plain(spark, sf):
    # No estimate months: every month before the first traffic month keeps 0.
    return allocate_traffic(_monthly(spark, sf), _traffic_m(spark, sf), cutoff="1900-01-01")


@query("apportion_counts")
def q_apportion_counts(spark, sf):
    return _alloc_plain(spark, sf).select("month", "product_key", "net_amount", *COUNTS)


@query("allocate_currency")
def q_allocate_currency(spark, sf):
    a = _alloc_plain(spark, sf)
    return a.select("month", "product_key", *[r6(c).alias(c) for c in MONEY + RATES + ["sales_per_order"]])


@query("estimate_missing_traffic")
def q_estimate_missing_traffic(spark, sf):
    a = allocate_traffic(_monthly(spark, sf), _traffic_m(spark, sf))
    return a.select("month", "product_key", "qty", "net_amount", "sales_amount", *COUNTS,
                    *[r6(c).alias(c) for c in MONEY + ["sales_per_order"] + RATES])


# --- feature table ---------------------------------------------------------


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (summation order differs between engines)."""
    return df.select(*[(F.round(F.col(c) * 10.0 ** places) / 10.0 ** places).alias(c)
                       if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def _feature_inputs(spark, sf):
    fx = _fx(spark, sf)
    return fx.sales(), fx.traffic(TRAFFIC_START), _stock(spark, sf), fx.holidays()


@query("feature_table")
def q_feature_table(spark, sf):
    return rounded(feature_table(*_feature_inputs(spark, sf)))


# --- lenient (core) path and forecasts --------------------------------------

FORECAST_HORIZON = 6


def _core_assembly(spark, sf):
    fx = _fx(spark, sf)
    return core_assembly(fx.sales(), fx.traffic(TRAFFIC_START), _stock(spark, sf), fx.holidays())


def _core_features(spark, sf):
    return core_features(_core_assembly(spark, sf))


def _history(spark, sf, features=None):
    f = _core_features(spark, sf) if features is None else features
    return f.select("product_key", month_from_text(F.col("month")).alias("month"), "total_qty",
                    "mom_growth_qty", "total_orders")


@query("core_assembly")
def q_core_assembly(spark, sf):
    return rounded(_core_assembly(spark, sf))


@query("core_features")
def q_core_features(spark, sf):
    return rounded(_core_features(spark, sf))


@query("training_rows")
def q_training_rows(spark, sf):
    t = training_rows(_core_features(spark, sf))
    return rounded(t.select("month", "product_key", "total_qty", *MODEL_FEATURES))


@query("future_months")
def q_future_months(spark, sf):
    return future_months(_history(spark, sf), FORECAST_HORIZON)


def _forecast(spark, sf, mode):
    return forecast_recursive(_history(spark, sf), FORECAST_HORIZON, scorer=DEFAULT_LINEAR, mode=mode)


@query("forecast_recursive")
def q_forecast_recursive(spark, sf):
    return rounded(_forecast(spark, sf, "core"))


@query("forecast_recursive_plain")
def q_forecast_recursive_plain(spark, sf):
    return rounded(_forecast(spark, sf, "plain"))


@query("forecast_fallback")
def q_forecast_fallback(spark, sf):
    # products whose key has an even length have no growth values: their scores fail and the product mean steps in
    gaps = _history(spark, sf).withColumn(
        "mom_growth_qty", F.when(F.length("product_key") % 2 == 1, F.col("mom_growth_qty")))
    strict = LinearScorer(DEFAULT_LINEAR.weights, missing_fails=True)
    return rounded(forecast_recursive(gaps, FORECAST_HORIZON, scorer=strict, mode="plain"))


@query("forecast_growth")
def q_forecast_growth(spark, sf):
    g = forecast_growth(_forecast(spark, sf, "core"), _history(spark, sf))
    return rounded(g.select("product_key", "month", "step", "forecast", "last_actual", "growth_pct"))


@query("history_and_forecast")
def q_history_and_forecast(spark, sf):
    return history_and_forecast(_history(spark, sf), _forecast(spark, sf, "core"))


# --- row-level cleaning (order lines) ----------------------------------------


ROW_ID = ["src_orderkey", "src_linenumber", "src_partkey", "src_suppkey"]


def _sales(spark, sf):
    return _fx(spark, sf).sales()


def _prep(spark, sf):
    return prepare_sales(_sales(spark, sf))


@query("product_key")
def q_product_key(spark, sf):
    return with_product_key(_sales(spark, sf)).select(*ROW_ID, "product_key")


@query("product_key_lenient")
def q_product_key_lenient(spark, sf):
    return with_product_key(_sales(spark, sf), lenient=True).select(*ROW_ID, "product_key")


@query("drop_cancelled")
def q_drop_cancelled(spark, sf):
    return drop_cancelled(_sales(spark, sf)).select(*ROW_ID, "status")


@query("order_month")
def q_order_month(spark, sf):
    return with_order_month(_sales(spark, sf)).select(*ROW_ID, "pay_date", "month")


@query("unit_price")
def q_unit_price(spark, sf):
    return _sales(spark, sf).select(*ROW_ID, r6(unit_price()).alias("unit_price"))


@query("discount_pct")
def q_discount_pct(spark, sf):
    return _sales(spark, sf).select(*ROW_ID, r6(discount_pct()).alias("discount_pct"))


@query("scaled_amount")
def q_scaled_amount(spark, sf):
    return _sales(spark, sf).select(*ROW_ID, scaled_amount("net_price").alias("scaled_amount"))


@query("parse_weight")
def q_parse_weight(spark, sf):
    return _sales(spark, sf).select(*ROW_ID, "weight_text", parse_weight(F.col("weight_text")).alias("weight"))


@query("parse_localized_number")
def q_parse_localized_number(spark, sf):
    t = _fx(spark, sf).traffic()
    return t.select("date_text", "sales_text", parse_localized_number(F.col("sales_text")).alias("sales"))


@query("parse_percent")
def q_parse_percent(spark, sf):
    t = _fx(spark, sf).traffic()
    return t.select("date_text", "conversion_rate_text",
                    parse_percent(F.col("conversion_rate_text")).alias("conversion_rate"))


@query("holiday_day_flag")
def q_holiday_day_flag(spark, sf):
    fx = _fx(spark, sf)
    return prepare_sales(fx.sales(), fx.holidays()).select(*ROW_ID, "pay_date", "is_holiday")


# --- monthly-grain operators -------------------------------------------------
_MK = ["month", "product_key"]


@query("calendar_features")
def q_calendar_features(spark, sf):
    return basic_features(_monthly(spark, sf)).select(*_MK, "year", "month_of_year", "quarter", "days_in_month")


@query("product_mean")
def q_product_mean(spark, sf):
    return basic_features(_monthly(spark, sf)).select(*_MK, "qty", "mean_qty_per_product")


# Inputs of the window features that a query does not look at.
_ABSENT = ["views", "visitors", "list_price", "opening_stock", "closing_stock"]


def _with_features(df):
    df = df.withColumns({c: F.lit(None).cast("double") for c in _ABSENT if c not in df.columns})
    return time_series_features(advanced_features(basic_features(df)))


def _features(spark, sf):
    return _with_features(allocate_traffic(_monthly(spark, sf), _traffic_m(spark, sf)))


def _stock_features(spark, sf):
    return _with_features(sales_stock_join(_monthly(spark, sf), _stock(spark, sf), ["opening_stock", "closing_stock"]))


@query("cyclic_month")
def q_cyclic_month(spark, sf):
    return _features(spark, sf).select(*_MK, r6("month_sin").alias("month_sin"), r6("month_cos").alias("month_cos"))


@query("quarter_flags")
def q_quarter_flags(spark, sf):
    return _features(spark, sf).select(*_MK, *[f"quarter_{q}" for q in (1, 2, 3, 4)])


@query("mom_growth")
def q_mom_growth(spark, sf):
    return _features(spark, sf).select(*_MK, *[r6(c).alias(c) for c in ("mom_growth_qty", "mom_growth_sales")])


@query("seasonal_index")
def q_seasonal_index(spark, sf):
    return _features(spark, sf).select(*_MK, r6("seasonal_index").alias("seasonal_index"))


@query("seasonal_profile")
def q_seasonal_profile(spark, sf):
    p = seasonal_profile(_monthly(spark, sf))
    return sx(p, "product_key", "posexplode(seasonal) AS (pos, v)").selectExpr(
        "product_key", "CAST(pos + 1 AS BIGINT) AS month_of_year", "round(v, 6) AS seasonal_index")


@query("rolling_3m")
def q_rolling_3m(spark, sf):
    return _features(spark, sf).select(*_MK, *[r6(c).alias(c) for c in (
        "rolling_3m_qty", "rolling_3m_sales", "rolling_3m_views")])


@query("trend_ratio")
def q_trend_ratio(spark, sf):
    return _features(spark, sf).select(*_MK, r6("trend_qty").alias("trend_qty"))


@query("lag_features")
def q_lag_features(spark, sf):
    return _features(spark, sf).select(*_MK, *[f"lag_{k}_{o}" for k in (1, 2, 3) for o in ("qty", "sales", "views")])


@query("linear_trend")
def q_linear_trend(spark, sf):
    m = _monthly(spark, sf)
    w = Window.partitionBy("product_key").orderBy(F.col("month").desc())
    last3 = (m.withColumn("rn", F.row_number().over(w)).where("rn <= 3")
              .groupBy("product_key").agg(F.sort_array(F.collect_list(F.struct("month", "qty"))).alias("h")))
    return last3.select("product_key", r6(linear_trend_last3(F.col("h.qty").cast("array<double>"))).alias("trend"))


@query("holiday_month_flag")
def q_holiday_month_flag(spark, sf):
    return holiday_month_flag(_monthly(spark, sf), _fx(spark, sf).holidays()).select(*_MK, "is_holiday_month")


@query("monthly_rollup")
def q_monthly_rollup(spark, sf):
    # 'mean' runs on a whole-number column: a mean of doubles differs in its
    # last bits between engines (summation order), which the check cannot hide.
    r = monthly_rollup(_prep(spark, sf), "paid_at", ["product_key"],
                       {"qty": "sum", "net_price": "sum", "list_price": "max", "src_linenumber": "mean",
                        "src_orderkey": "nunique"})
    return r.select("month", "product_key", "qty", r6("net_price").alias("net_price"), "list_price",
                    r6("src_linenumber").alias("src_linenumber"), "src_orderkey")


@query("monthly_row_counts")
def q_monthly_row_counts(spark, sf):
    return monthly_row_counts(_sales(spark, sf), "paid_at")


@query("dataset_summary")
def q_dataset_summary(spark, sf):
    return dataset_summary(_monthly(spark, sf))


@query("product_info_first")
def q_product_info_first(spark, sf):
    return rounded(product_info_first(_prep(spark, sf), INFO_COLUMNS, SOURCE_ORDER))


@query("product_list")
def q_product_list(spark, sf):
    return product_list(_monthly(spark, sf))


@query("top_products")
def q_top_products(spark, sf):
    return top_products(_monthly(spark, sf), 10)


@query("encode_status")
def q_encode_status(spark, sf):
    st = _fx(spark, sf).stock_status()
    return encode_labels(st, "stock_status", "stock_status_code").select(
        "product_key", "month_text", "stock_status", "stock_status_code")


@query("column_medians")
def q_column_medians(spark, sf):
    a = allocate_traffic(_monthly(spark, sf), _traffic_m(spark, sf))
    return rounded(column_medians_frame(a, ["qty", "net_amount", "orders", "cancelled_sales",
                                            "sales_per_order", "conversion_rate"]))


@query("monthly_medians")
def q_monthly_medians(spark, sf):
    r = monthly_rollup(_prep(spark, sf), "paid_at", ["product"],
                       {"net_price": ["median", "count"], "qty": "median", "src_orderkey": "median"})
    return rounded(r)


@query("product_medians")
def q_product_medians(spark, sf):
    # infinite and missing values among them: sales per shipping fee, some of which are 0
    s = _sales(spark, sf).withColumn("ratio", ieee_div(F.col("net_price"), F.col("return_shipping")))
    return rounded(grouped_medians(s, ["product", "variant"], ["net_price", "ratio", "qty"]))


# --- joins ---------------------------------------------------------------------
@query("sales_traffic_join")
def q_sales_traffic_join(spark, sf):
    return rounded(sales_traffic_join(_monthly(spark, sf), _traffic_m(spark, sf)))


@query("sales_product_info_join")
def q_sales_product_info_join(spark, sf):
    info = product_info_first(_prep(spark, sf), INFO_COLUMNS, SOURCE_ORDER)
    return rounded(sales_product_info_join(_monthly(spark, sf), info))


@query("sales_stock_join")
def q_sales_stock_join(spark, sf):
    return sales_stock_join(_monthly(spark, sf), _stock(spark, sf),
                            ["product_id", "opening_stock", "closing_stock", "pending", "stock_status"])


def _join_sides(spark, sf):
    left = _monthly(spark, sf).select(month_text(F.col("month")).alias("month_text"), "product_key", "qty",
                                      "net_amount")
    right = _stock(spark, sf).select("product_key", "month_text", F.col("sold_qty").alias("qty"),
                                                 "opening_stock", "stock_status")
    return left, right


def _safe(how):
    def q(spark, sf):
        left, right = _join_sides(spark, sf)
        return safe_join(left, right, ["product_key", "month_text", "not_a_column"], how)
    return q


for _how in ("left", "right", "outer", "inner"):
    QUERIES[f"safe_join_{_how}"] = _safe(_how)


@query("safe_join_hot_keys")
def q_safe_join_hot_keys(spark, sf):
    # a third of the orders have no customer, as have some rows of the customer table; one segment's key is hot too
    fx = _fx(spark, sf)
    k = F.col("o_orderkey")
    left = fx.table("orders").select(
        F.when(k % 3 == 0, None).when(k % 7 == 0, 1).otherwise(F.col("o_custkey")).cast("long").alias("custkey"),
        k.alias("orderkey"), F.col("o_totalprice").alias("amount"))
    c = F.col("c_custkey")
    right = fx.table("customer").select(
        F.when(c % 400 == 5, None).when(c % 300 == 7, -1).otherwise(c).cast("long").alias("custkey"),
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    return safe_join(left, right, ["custkey"], "outer", hot_share=0.05)


@query("stock_turnover")
def q_stock_turnover(spark, sf):
    return _stock_features(spark, sf).select(*_MK, r6("stock_turnover").alias("stock_turnover"))


@query("stock_coverage")
def q_stock_coverage(spark, sf):
    return _stock_features(spark, sf).select(*_MK, r6("stock_coverage").alias("stock_coverage"))


@query("price_level")
def q_price_level(spark, sf):
    # the highest list price of each month: a price that varies, unlike the product's first row
    price = (_prep(spark, sf).where("product_key IS NOT NULL AND month IS NOT NULL")
             .groupBy("month", "product_key").agg(F.max("list_price").alias("list_price"), F.sum("qty").alias("qty")))
    return _with_features(price.withColumn("sales_amount", F.col("qty"))).select(
        *_MK, r6("price_level").alias("price_level"))


@query("traffic_ratios")
def q_traffic_ratios(spark, sf):
    return _features(spark, sf).select(*_MK, *[r6(c).alias(c) for c in (
        "view_to_sales_ratio", "visitor_to_sales_ratio", "visitor_to_view_ratio")])


@query("interaction_features")
def q_interaction_features(spark, sf):
    f = features_unfilled(joined_monthly(*_feature_inputs(spark, sf)))
    return f.select(*_MK, r6("price_view_interaction").alias("price_view_interaction"),
                    r6("stock_demand_interaction").alias("stock_demand_interaction"))


# --- evaluation, training, comparison ---------------------------------------------
def _training(spark, sf):
    return training_rows(_core_features(spark, sf))


@query("regression_metrics")
def q_regression_metrics(spark, sf):
    # naive last-value forecast of each training row, scored against the truth
    return rounded(regression_metrics(_training(spark, sf), "total_qty", "lag_1_qty"))


@query("feature_correlation")
def q_feature_correlation(spark, sf):
    return rounded(feature_correlation(_training(spark, sf), MODEL_FEATURES, "total_qty"))


@query("train_test_split")
def q_train_test_split(spark, sf):
    t = train_test_split(_training(spark, sf), ["product_key", "month"])
    return t.select("product_key", "month", "total_qty", "is_train")


def _feature_rows(spark, sf):
    """The features by product and month, computed once: training, scoring and history read them again."""
    return cut_lineage(_core_features(spark, sf).select("product_key", "month", "total_qty", *MODEL_FEATURES))


_MODELS: dict[tuple[str, str], tuple] = {}   # one fit and its feature rows per session and folder: three queries use it


def _gbt(spark, sf):
    """(model, held-out rows, feature rows)."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _MODELS:
        features = _feature_rows(spark, sf)
        t = train_test_split(training_rows(features), ["product_key", "month"])
        _MODELS[at] = train_gbt(t.where("is_train")), t.where("NOT is_train"), features
    return _MODELS[at]


@query("train_gbt")
def q_train_gbt(spark, sf):
    model, test, _ = _gbt(spark, sf)
    finite = F.col("prediction").isNotNull() & ~F.isnan("prediction") & (F.abs("prediction") < float("inf"))
    return score(model, test).select("product_key", "month", "total_qty", finite.alias("prediction_finite"))


@query("gbt_metrics")
def q_gbt_metrics(spark, sf):
    # the model must beat the product mean on the held-out rows, by both error measures
    model, test, _ = _gbt(spark, sf)
    m = gbt_metrics(model, test).first()
    base = regression_metrics(test, "total_qty", "mean_qty_per_product").first()
    return test.agg(F.count(F.lit(1)).alias("test_rows")).select(
        "test_rows", F.lit(m["valid_samples"]).cast("long").alias("valid_samples"),
        F.lit(m["rmse"] < base["rmse"]).alias("rmse_below_product_mean"),
        F.lit(m["mae"] < base["mae"]).alias("mae_below_product_mean"))


@query("forecast_gbt")
def q_forecast_gbt(spark, sf):
    model, _, features = _gbt(spark, sf)
    f = forecast_recursive(_history(spark, sf, features), FORECAST_HORIZON, scorer=model, mode="core")
    # every step's features go through the fitted model itself: its score, clamped and rounded, is the forecast
    own = score(model, f.withColumnsRenamed({f"feature_{c}": c for c in MODEL_FEATURES}))
    raw = F.greatest(F.lit(0.0), F.bround("prediction", 0)).cast("long")
    first = {c: F.when(F.col("step") == 1, r6(c)) for c in ("lag_1_qty", "rolling_3m_qty", "seasonal_index", "trend_qty")}
    return own.select("product_key", "month", "step", F.col("mean_qty_per_product").isNotNull().alias("known"),
                      (F.col("forecast") >= 0).alias("whole_and_not_negative"),
                      (F.col("forecast") == raw).alias("equals_transform"),
                      *[x.alias(f"first_{c}") for c, x in first.items()])


@query("saved_model_forecast")
def q_saved_model_forecast(spark, sf):
    # a model that was saved and read again forecasts what it forecast before
    features = _feature_rows(spark, sf)
    model = train_boosted(training_rows(features), settings=BoostSettings(trees=5))
    path = scratch_path(spark, "model")
    model.save(spark, path)
    before, after = (forecast_recursive(_history(spark, sf, features), FORECAST_HORIZON, scorer=m, mode="core").select(
        "product_key", "month", "step", F.col("forecast").alias(name))
        for m, name in ((model, "before"), (Ensemble.load(spark, path), "after")))
    return before.join(after, ["product_key", "month", "step"], "full_outer").select(
        "product_key", "month", "step", F.col("before").isNotNull().alias("known"),
        F.col("before").eqNullSafe(F.col("after")).alias("same"))


@query("exported_forecasts")
def q_exported_forecasts(spark, sf):
    # the time-stamped export, read again from its files
    path = export_forecasts(_forecast(spark, sf, "core").select("product_key", "month", "step", "forecast"),
                            scratch_path(spark, "forecasts"))
    back = read_table(spark, path, fmt="csv")
    return back.select("product_key", F.col("month").cast("date").alias("month"), F.col("step").cast("int").alias("step"),
                       F.col("forecast").cast("bigint").alias("forecast"))


@query("forecast_totals")
def q_forecast_totals(spark, sf):
    return rounded(forecast_totals(_forecast(spark, sf, "core")))


# --- regularised boosting -----------------------------------------------------------
PLANTED_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("boosted_trees")
def q_boosted_trees(spark, sf):
    # every node of two trees over the order lines: splits, rows, leaf values
    lines = _fx(spark, sf).table("lineitem")
    model = train_boosted(lines, PLANTED_FEATURES, "l_extendedprice", BoostSettings(trees=2, depth=2))
    nodes = model.node_table(spark)
    return nodes.select("round", "node", "kind", "feature", "threshold", "n_rows",
                        (F.round(F.col("value") * 1e3) / 1e3).alias("value"))


@query("boosted_metrics")
def q_boosted_metrics(spark, sf):
    # regularised trees must beat the product mean on the held-out rows, by both error measures
    t = train_test_split(training_rows(_feature_rows(spark, sf)), ["product_key", "month"])
    model = train_boosted(t.where("is_train"), settings=BoostSettings(trees=30))
    test = t.where("NOT is_train")
    m = regression_metrics(model.transform(test), "total_qty", "prediction").first()
    base = regression_metrics(test, "total_qty", "mean_qty_per_product").first()
    return test.agg(F.count(F.lit(1)).alias("test_rows")).select(
        "test_rows", F.lit(m["valid_samples"]).cast("long").alias("valid_samples"),
        F.lit(m["rmse"] < base["rmse"]).alias("rmse_below_product_mean"),
        F.lit(m["mae"] < base["mae"]).alias("mae_below_product_mean"))


@query("grid_search")
def q_grid_search(spark, sf):
    # a planted target that needs two features at once: depth 2 must win
    either = (F.col("l_quantity") > 25) != (F.col("l_linenumber") > 3)
    lines = _fx(spark, sf).table("lineitem").withColumn("y", F.when(either, 100.0).otherwise(F.col("l_discount")))
    found = boosted_grid(lines, {"depth": [1, 2], "l2": [0.0, 1.5]}, PLANTED_FEATURES, "y", folds=3,
                         keys=["l_orderkey", "l_linenumber"], base=BoostSettings(trees=4, l1=0.0, rate=0.5), refit=False)
    point = F.array(*[F.struct(F.lit(p.depth).alias("depth"), F.lit(p.l2).alias("l2"), F.lit(p.depth == found.best.depth).alias("best"))
                      for p in found.settings])[F.col("setting")]
    return found.scores.select(point["depth"].alias("depth"), point["l2"].alias("l2"), "fold", "n_train", "n_held_out",
                               point["best"].alias("best"), (F.col("rmse") < 20.0).alias("fits"))


def _compare_sides(spark, sf):
    strict = _monthly(spark, sf).select(month_text(F.col("month")).alias("month_text"), "product_key", "qty",
                                        "net_amount", "sales_amount")
    lenient = _core_assembly(spark, sf).select(F.col("month").alias("month_text"), "product_key", "qty",
                                               F.col("net_price").alias("net_amount"), "orders")
    return strict, lenient


@query("compare_shape")
def q_compare_shape(spark, sf):
    return compare_shape(*_compare_sides(spark, sf))


def _planted_sides(spark, sf):
    """Orders, and a copy with differences planted by key: values, missing values, text, a dropped share of rows."""
    o = _fx(spark, sf).table("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus",
                                              "o_orderpriority")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    changed = o.where(k % 211 != 0).select(
        "o_orderkey", F.when(k % 113 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 97 == 0, price * 1.001).when(k % 101 == 0, F.lit(None)).when(k % 103 == 0, price * (1 + 1e-13))
        .when(k % 107 == 0, F.lit(float("nan"))).otherwise(price).alias("o_totalprice"),
        F.when(k % 89 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return o, changed


@query("compare_values")
def q_compare_values(spark, sf):
    a, b = _planted_sides(spark, sf)
    return rounded(compare_values(a, b, ["o_orderkey"]))


@query("compare_repeated_keys")
def q_compare_repeated_keys(spark, sf):
    a, b = (d.select("o_custkey", "o_totalprice", "o_orderstatus") for d in _planted_sides(spark, sf))
    return rounded(compare_values(a, b, ["o_custkey"]))


@query("compare_verdict")
def q_compare_verdict(spark, sf):
    return compare_verdict(*_planted_sides(spark, sf), ["o_orderkey"])


@query("compare_nulls")
def q_compare_nulls(spark, sf):
    return compare_nulls(*_compare_sides(spark, sf))


# --- header handling -------------------------------------------------------------


@query("date_parse_rates")
def q_date_parse_rates(spark, sf):
    fx = _fx(spark, sf)
    h = date_parse_rates(fx.holidays(), "date_text").withColumn("source", F.lit("holidays"))
    t = date_parse_rates(fx.traffic(), "date_text").withColumn("source", F.lit("traffic"))
    return h.unionByName(t).select("source", "strategy", "strategy_order", r6("parsed_share").alias("parsed_share"))


@query("parse_dates")
def q_parse_dates(spark, sf):
    # order days as text, day first in one column and month first in the other, with some junk in both
    o = _fx(spark, sf).table("orders").where("o_orderdate IS NOT NULL")
    texts = o.select("o_orderkey", *[
        F.when(F.col("o_orderkey") % k == 0, "unknown").otherwise(F.date_format("o_orderdate", form)).alias(c)
        for c, form, k in (("day_first", "d/M/yyyy", 7), ("month_first", "M/d/yyyy", 11))])
    return parse_dates(parse_dates(texts, "day_first"), "month_first").select(
        "o_orderkey", *[F.col(c).cast("date").alias(c) for c in ("day_first", "month_first")])


@query("resolve_columns")
def q_resolve_columns(spark, sf):
    # every table under its source headers: which header each logical field finds, and how many values it holds
    fx = _fx(spark, sf)
    tables = {"sales": fx.sales().withColumnsRenamed({"paid_at": "Tanggal", "net_price": "Harga"}),
              "traffic": fx.traffic(), "stock_status": fx.stock_status().withColumnsRenamed({"month_text": "Bulan"}),
              "shop_stock": fx.shop_stock(), "holidays": fx.holidays()}
    parts = []
    for role, df in tables.items():
        found = {f: h for f, h in resolve_columns(df, role).items() if h}
        row = df.agg(*[F.count(F.col(h)).alias(f) for f, h in found.items()])
        stack = ", ".join(f"'{f}', '{h}', `{f}`" for f, h in found.items())
        parts.append(row.selectExpr(f"'{role}' AS role", f"stack({len(found)}, {stack}) AS (field, header, n_values)"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("header_defaults")
def q_header_defaults(spark, sf):
    # renames and drops of columns that may be absent, defaults and copies for those that are
    t = rename_columns(_fx(spark, sf).traffic(), {"orders": "total_orders", "not_there": "x"})
    t = drop_if_present(t, ["sales_text", "not_there", *[c for c in t.columns if c.endswith("_rate_text")]])
    t = ensure_column(ensure_column(t, "page_views", copy_from="views"), "refunds", default=0.0)
    t = ensure_column(ensure_column(t, "buyers", default=-1), "remark", default="none", copy_from="not_there")
    return t.select("date_text", "total_orders", "page_views", "refunds", "buyers", "remark",
                    F.lit(len(t.columns)).alias("n_columns"))


@query("product_rows")
def q_product_rows(spark, sf):
    # one product's rows of the monthly table: the one whose key comes first
    m = _monthly(spark, sf)
    first = product_list(m).agg(F.min("product_key")).first()[0]
    return m.where(F.col("product_key") == first).select("month", "product_key", "qty", "net_amount")


@query("table_round_trip")
def q_table_round_trip(spark, sf):
    # the monthly roll-up written in order as CSV, read again with its month parsed back
    path = scratch_path(spark, "round-trip")
    m = _monthly(spark, sf)
    write_table(m.withColumn("month", month_text(F.col("month"))), path, fmt="csv", sort_by=["product_key", "month"])
    back = read_table(spark, path, fmt="csv", month_col="month")
    return back.select(F.col("month_date").alias("month"), "product_key",
                       *[F.col(c).cast("bigint").alias(c) for c in ("qty", "net_amount", "sales_amount")])


# --- folders of exports that do not agree -----------------------------------------


def _export(df, path, columns, encoding="UTF-8"):
    """Appends CSV files with the given (header, column) pairs, in this order."""
    df.select(*[F.col(c).alias(h) for h, c in columns]).write.mode("append").option("header", True).option(
        "escape", '"').option("encoding", encoding).csv(path)


@query("mixed_headers")
def q_mixed_headers(spark, sf):
    # order lines in three exports that name and order their columns differently; one has no variants
    path = scratch_path(spark, "mixed-headers")
    s = _sales(spark, sf).withColumn("paid_at", F.date_format("paid_at", "yyyy-MM-dd"))
    k = F.col("src_linenumber") % 3
    _export(s.where(k == 0), path, [("Waktu Pembayaran Dilakukan", "paid_at"), ("Nama Produk", "product"),
                                    ("Nama Variasi", "variant"), ("Jumlah", "qty"), ("Harga Setelah Diskon", "net_price")])
    _export(s.where(k == 1), path, [("Price", "net_price"), ("Qty", "qty"), ("No", "src_orderkey"), ("SKU", "variant"),
                                    ("Date", "paid_at"), ("Item", "product")])
    _export(s.where(k == 2), path, [("Produk", "product"), ("Tanggal", "paid_at"), ("Harga", "net_price"),
                                    ("Quantity", "qty")])
    back = read_role_folder(spark, path, "sales", {"date": "date", "product": "string", "variant": "string",
                                                   "quantity": "bigint", "price": "double"})
    return back.groupBy("date", "product", "variant").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("quantity"),
        r6(F.sum(F.col("price").cast("decimal(38,6)"))).alias("price"))


@query("mixed_columns")
def q_mixed_columns(spark, sf):
    # stock status of a year in one export each: turned round in odd years, without two columns in every third
    path = scratch_path(spark, "mixed-columns")
    st = _fx(spark, sf).stock_status().withColumn("remark", F.concat(F.lit("a, \"b\" "), F.col("product_key")))
    columns = [(h, name) for h, (name, _) in SOURCE_TABLES["stock_status"].items()]
    year = F.substring("month_text", 1, 4).cast("int")
    few = [c for c in columns if c[1] not in ("pending", "opening_stock")] + [("Catatan", "remark")]
    _export(st.where(year % 3 == 0), path, few)
    _export(st.where((year % 3 != 0) & (year % 2 == 1)), path, columns[::-1])
    _export(st.where((year % 3 != 0) & (year % 2 == 0)), path, columns)
    return read_source_table(spark, path, "stock_status").withColumnRenamed("Catatan", "remark")


@query("mixed_encodings")
def q_mixed_encodings(spark, sf):
    # products with accents, half of them exported as Latin-1
    path = scratch_path(spark, "mixed-encodings")
    shop = _fx(spark, sf).shop_stock().withColumn("variant", F.translate("variant", "AEIOU", "ÀÉÎÖü"))
    columns = [(h, name) for h, (name, _) in SOURCE_TABLES["shop_stock"].items()]
    half = F.col("product_code") % 2 == 0
    _export(shop.where(half), path, columns)
    _export(shop.where(~half), path, columns, "ISO-8859-1")
    return read_source_table(spark, path, "shop_stock")
