"""The driver contract: flagship query, registry and oracle keys."""

import __spark_entry__ as E


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert "feature_table" in q and "feature_table" in o


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"product_key", "month", "qty", "date_index"} <= set(df.columns)


EXPECTED = {
    "allocate_currency", "apportion_counts", "calendar_features", "column_medians", "compare_nulls",
    "compare_shape", "compare_values", "compare_repeated_keys", "compare_verdict", "forecast_gbt", "forecast_fallback", "resolve_columns",
    "table_round_trip", "core_assembly", "core_features", "cyclic_month", "dataset_summary",
    "date_parse_rates", "discount_pct", "drop_cancelled", "encode_status", "estimate_missing_traffic",
    "feature_correlation", "feature_table", "forecast_growth", "forecast_recursive", "forecast_recursive_plain",
    "forecast_totals", "future_months", "mixed_columns", "mixed_encodings", "mixed_headers", "gbt_metrics", "history_and_forecast", "holiday_day_flag",
    "holiday_month_flag", "interaction_features", "lag_features", "linear_trend", "mom_growth", "month_share",
    "monthly_medians", "product_medians", "monthly_product_sales", "monthly_rollup", "monthly_row_counts", "monthly_traffic", "order_month",
    "parse_dates", "parse_localized_number", "parse_percent", "parse_weight", "price_level", "product_info_first",
    "saved_model_forecast", "exported_forecasts", "header_defaults", "product_rows",
    "product_key", "product_key_lenient", "product_list", "product_mean", "quarter_flags", "regression_metrics",
    "rolling_3m", "safe_join_hot_keys", "safe_join_inner", "safe_join_left", "safe_join_outer", "safe_join_right",
    "sales_product_info_join", "sales_stock_join", "sales_traffic_join", "scaled_amount", "seasonal_index",
    "seasonal_profile", "stock_coverage", "stock_turnover", "top_products", "traffic_ratios",
    "traffic_ratios_global", "train_gbt", "train_test_split", "training_rows", "trend_ratio", "unit_price",
}


def test_no_query_lost():
    q, o = set(E.queries()), set(E.oracle_sql())
    assert EXPECTED <= q
    own = {n for n in q if n != "pipeline" and not n.startswith("op")}   # the text operators have tests of their own
    assert own <= o                                                    # every query here has its SQL
