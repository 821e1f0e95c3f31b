"""The notebook path end to end on hand-written edge rows."""

import datetime as dt
import math

from retailcast.plans.feature_table import feature_table

SALES = ("src_orderkey long, src_linenumber int, src_partkey long, src_suppkey long, paid_at timestamp_ntz, "
         "product string, variant string, status string, qty long, list_price double, net_price double, "
         "weight_text string, total_weight_text string, seller_voucher double, shipping_fee double, "
         "total_payment double")
TRAFFIC = ("date_text string, sales_text string, orders long, sales_per_order_text string, views long, visitors long, "
           "conversion_rate_text string, cancelled_orders long, cancelled_sales double, returned_orders long, "
           "returned_sales double, buyers long, repeat_rate_text string")
STOCK = ("product_id long, month_text string, product_key string, opening_stock long, sold_qty long, "
         "closing_stock long, pending long, stock_status string")


def ts(y, m, d):
    return dt.datetime(y, m, d)


def test_edge_rows(spark):
    sales = [
        (1, 1, 1, 1, ts(2024, 1, 5), "A", "red", None, 2, 10.0, 8.0, "1.200 gr", "2.400 gr", 0.0, 0.0, 8.0),
        (1, 2, 1, 1, ts(2024, 1, 9), "A", "red", "Batal", 5, 10.0, 8.0, "1.200 gr", "6.000 gr", 0.0, 0.0, 8.0),
        (2, 1, 2, 1, ts(2024, 2, 1), "A", "red", "Selesai", 0, 0.0, 0.0, "1.200 gr", "0 gr", 0.0, 0.0, 0.0),
        (3, 1, 3, 1, None, "A", "red", None, 4, 10.0, 9.0, "1.200 gr", "x", 0.0, 0.0, 9.0),      # bad date
        (4, 1, 4, 1, ts(2024, 1, 7), None, "blue", None, 3, 5.0, 5.0, "500 gr", "1.500 gr", 0.0, 0.0, 5.0),  # null product
        (5, 1, 5, 1, ts(2024, 2, 3), "B", None, None, 1, 20.0, 15.0, "abc", "abc", 0.0, 0.0, 15.0),
    ]
    traffic = [("10/02/2024", "1.000,00", 4, "250,00", 40, 20, "10,00%", 1, 100.0, 0, 0.0, 3, "5,00%")]
    stock = [(7, "2024-01", "A - red", 5, 2, 3, 0, "Kurang Optimal")]
    holidays = spark.createDataFrame([("1/1/2024", "New Year", 2024)], "date_text string, holiday_name string, year int")
    ft = feature_table(spark.createDataFrame(sales, SALES), spark.createDataFrame(traffic, TRAFFIC),
                       spark.createDataFrame(stock, STOCK), holidays)
    rows = {(r.product_key, r.month): r for r in ft.collect()}
    # the cancelled line and the dateless line are out; the null product has no key
    assert set(rows) == {("A - red", "2024-01"), ("A - red", "2024-02"), ("B - Tidak ada variasi", "2024-02")}
    a1, a2, b = rows[("A - red", "2024-01")], rows[("A - red", "2024-02")], rows[("B - Tidak ada variasi", "2024-02")]
    assert a1.qty == 2 and a1.net_amount == 8000 and a2.qty == 0
    assert a1.is_holiday_month and not a2.is_holiday_month
    assert a1.stock_status == "Kurang Optimal" and a2.stock_status == "Unknown"
    assert a1.stock_status_code == 0 and a2.stock_status_code == 1
    # growth 2 -> 0 is -1; first row growth NULL -> 0
    assert a2.mom_growth_qty == -1.0 and a1.mom_growth_qty == 0.0
    # February traffic splits by net amount: A has 0, B has all of it
    assert b.orders == 4 and a2.orders == 1  # the floor of 1 applies after the split
    # weight text 'abc' cannot be parsed -> filled with the column median (1200)
    assert b.weight == 1200.0
    assert all(not (isinstance(v, float) and (math.isnan(v) or math.isinf(v))) for r in rows.values() for v in r)
