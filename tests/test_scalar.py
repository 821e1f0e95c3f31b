"""Scalar rules: division, localized numbers, keys, cancellation, rounding."""

import math

from pyspark.sql import functions as F

from retailcast.functions.keys import product_key, product_key_lenient
from retailcast.functions.numeric import half_even, ieee_div
from retailcast.functions.text import parse_localized_number, parse_percent, parse_weight
from retailcast.operators.clean import discount_pct, drop_cancelled


def test_ieee_div(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0), (6.0, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(ieee_div("a", "b")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf
    assert got[2] is None and got[3] is None and got[4] == 2.0


def test_localized_numbers(spark):
    df = spark.createDataFrame([("1.234,5",), ("abc",), ("",), ("nan",), (None,), ("12",)], "s string")
    got = [r[0] for r in df.select(parse_localized_number("s")).collect()]
    assert got == [1234.5, None, None, None, None, 12.0]
    p = spark.createDataFrame([("2,34%",), ("x%",)], "s string").select(parse_percent("s")).collect()
    assert [r[0] for r in p] == [2.34, None]
    w = spark.createDataFrame([("1.200 gr",), ("750 gr",)], "s string").select(parse_weight("s")).collect()
    assert [r[0] for r in w] == [1200.0, 750.0]


def test_product_keys(spark):
    df = spark.createDataFrame([("A", "red"), ("A", None), (None, "red")], "p string, v string")
    strict = [r[0] for r in df.select(product_key("p", "v")).collect()]
    assert strict == ["A - red", "A - Tidak ada variasi", None]
    lenient = [r[0] for r in df.select(product_key_lenient("p", "v")).collect()]
    assert lenient == ["A - red", "A - ", "nan - red"]


def test_null_status_is_kept(spark):
    df = spark.createDataFrame([("Batal",), (None,), ("Selesai",)], "status string")
    assert sorted(r[0] or "" for r in drop_cancelled(df).collect()) == ["", "Selesai"]


def test_half_even_and_discount(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(half_even("x")).collect()] == [2.0, 4.0, -2.0]
    d = spark.createDataFrame([(0.0, 5.0), (0.0, 0.0), (100.0, 80.0), (None, 1.0)], "list_price double, net_price double")
    got = [r[0] for r in d.select(discount_pct()).collect()]
    assert got[0] == -math.inf and got[1] == 0.0 and abs(got[2] - 20.0) < 1e-12 and got[3] == 0.0


def test_unit_price_zero_quantity(spark):
    from retailcast.operators.clean import unit_price
    df = spark.createDataFrame([(10.0, 0), (0.0, 0), (9.0, 3)], "net_price double, qty long")
    got = [r[0] for r in df.select(unit_price()).collect()]
    assert got[0] == math.inf and got[1] is None and got[2] == 3.0
