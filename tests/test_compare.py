"""Comparison operators on tables with planted differences."""

from retailcast.operators.compare import compare_nulls, compare_shape, compare_values


def test_compare_planted(spark):
    a = spark.createDataFrame([(1, 1.0, "x", 5), (2, 2.0, None, 6), (3, 3.0, "z", 7)],
                              "k long, v double, s string, t long")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, "x", 5.0), (2, 2.0 + 1e-9, None, 6.0), (3, None, "Z", 7.0)],
                              "k long, v double, s string, t double")
    vals = {r["column"]: r for r in compare_values(a, b, ["k"]).collect()}
    assert vals["v"].different_rows == 2          # 1e-9 off and a planted NULL; 1e-12 is within tolerance
    assert vals["s"].different_rows == 1 and vals["s"].type_match
    assert vals["t"].type_match is False and vals["t"].different_rows is None
    shape = compare_shape(a, b.drop("t")).collect()[0]
    assert shape.rows_processed == 3 and shape.extra_columns == "t" and shape.shape_match is False
    nulls = {r["column"]: (r.null_count_processed, r.null_count_reference) for r in compare_nulls(a, b).collect()}
    assert nulls["v"] == (0, 1) and nulls["s"] == (1, 1)


def test_compare_repeated_keys(spark):
    a = spark.createDataFrame([(1, float(i)) for i in range(500)] + [(2, 1.0)], "k long, v double")
    b = spark.createDataFrame([(1, float(i)) for i in range(500)] + [(2, 1.5)], "k long, v double")
    vals = {r["column"]: r for r in compare_values(a, b, ["k"]).collect()}
    # the 500 copies of key 1 pair up value for value; only key 2 differs
    assert vals["v"].different_rows == 1 and vals["v"].max_difference == 0.5


def values(a, b, keys=("k",)):
    return {r["column"]: r for r in compare_values(a, b, list(keys)).collect()}


def copies(spark, fn, n=500, schema="k long, v double"):
    return spark.createDataFrame([(1, *fn(i)) for i in range(n)], schema)


def test_repeated_key_within_the_tolerance(spark):
    a = copies(spark, lambda i: (float(i) + 1,))
    b = copies(spark, lambda i: ((float(i) + 1) * (1 + 1e-12),))
    assert values(a, b)["v"].different_rows == 0


def test_repeated_key_with_one_value_changed(spark):
    a = copies(spark, lambda i: (float(i),))
    b = copies(spark, lambda i: (9000.0 if i == 17 else float(i),))
    r = values(a, b)["v"]
    assert r.different_rows == 1 and r.max_difference == 9000.0 - 17 and abs(r.mean_difference - 8983 / 500) < 1e-9


def test_repeated_key_with_an_extra_column(spark):
    a = copies(spark, lambda i: (float(i),))
    b = copies(spark, lambda i: (float(i), i), schema="k long, v double, extra long")
    assert values(a, b)["v"].different_rows == 0


def test_infinities_and_missing(spark):
    inf, nan = float("inf"), float("nan")
    sides = [(5.0, inf), (inf, inf), (-inf, inf), (nan, None), (None, None), (nan, nan), (1.0, nan), (2.0, 4.0)]
    a = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(sides[3:])], "k long, v double")
    b = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(sides[3:])], "k long, v double")
    r = values(a, b)["v"]
    assert (r.different_rows, r.max_difference, r.mean_difference) == (2, 2.0, 2.0)
    for (x, y), differ in zip(sides[:3], (1, 0, 1)):
        one = [spark.createDataFrame([(1, z)], "k long, v double") for z in (x, y)]
        assert values(*one)["v"].different_rows == differ


def test_rows_without_a_partner_and_null_keys(spark):
    a = spark.createDataFrame([(None, 1.0, "x"), (None, 1.0, "x"), (2, 1.0, "y"), (3, 1.0, None)], "k long, v double, s string")
    b = spark.createDataFrame([(None, 1.0, "x"), (2, 1.0, "y"), (4, 1.0, None)], "k long, v double, s string")
    r = values(a, b)
    assert r["v"].different_rows == 3 and r["s"].different_rows == 3


def test_verdict(spark):
    from retailcast.operators.compare import compare_verdict
    a = spark.createDataFrame([(1, 1.0, 5), (2, 2.0, 6)], "k long, v double, t long")
    ok = compare_verdict(a, a, ["k"]).first()
    assert ok.success and ok.n_differences == 0 and ok.message == ""
    b = spark.createDataFrame([(1, 1.5, 5.0, "z")], "k long, v double, t double, w string")
    bad = compare_verdict(a, b, ["k"]).first()
    assert not bad.success
    assert bad.message == ("rows: 2 instead of 1; missing columns: w; t: type bigint instead of double; "
                           "v: 2 rows differ")


def test_hot_repeated_rows_spread(spark):
    a = spark.createDataFrame([(1, 1.0)] * 3000 + [(1, 2.0)] * 10, "k long, v double")
    b = spark.createDataFrame([(1, 1.0)] * 2990 + [(1, 2.0)] * 20, "k long, v double")
    assert values(a, b)["v"].different_rows == 10
