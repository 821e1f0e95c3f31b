"""Roll-up edge behaviour."""

import datetime as dt

from retailcast.operators.rollup import (monthly_rollup, monthly_sales_with_first, product_info_first,
                                         product_info_from_monthly, top_products)


def test_rollup_without_date_is_empty(spark):
    df = spark.createDataFrame([("a", 1)], "product_key string, qty long")
    assert monthly_rollup(df, None, ["product_key"], {"qty": "sum"}).count() == 0
    assert monthly_rollup(df, "nope", ["product_key"], {"qty": "sum"}).count() == 0


def test_first_row_in_source_order(spark):
    rows = [(3, "a", dt.date(2024, 2, 1), 1, 5.0, "late"), (1, "a", None, 1, 5.0, "first-no-date"),
            (2, "a", dt.date(2024, 1, 1), 1, 5.0, "second"), (4, "b", dt.date(2024, 1, 1), 2, 1.0, "b1")]
    df = spark.createDataFrame(rows, "ord long, product_key string, month date, qty long, net_price double, tag string")
    direct = {r.product_key: r.tag for r in product_info_first(df, ["tag"], ["ord"]).collect()}
    agg = monthly_sales_with_first(df, order_by="ord")
    via = {r.product_key: r.tag for r in product_info_from_monthly(agg, df, ["tag"], ["ord"]).collect()}
    assert direct == via == {"a": "first-no-date", "b": "b1"}
    # the dateless line is not a monthly row
    assert agg.where("month IS NOT NULL").count() == 3


def test_top_products_ties(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", 1)], "product_key string, qty long")
    assert [r.product_key for r in top_products(df, 3).collect()] == ["c", "a", "b"]


def test_several_functions_per_column(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.date(2024, 1, 2), 1, 0.1), (dt.date(2024, 1, 3), 3, 0.2)], "d date, q long, x double")
    r = monthly_rollup(df, "d", [], {"q": ["sum", "mean", "median"], "x": "sum"}).collect()[0]
    assert (r.month, r.q_sum, r.q_mean, r.x) == ("2024-01", 4, 2.0, 0.3)
    assert r.q_median == 2.0   # exact, the mean of the middle two


def test_first_rows_without_sorting_the_lines(spark):
    from retailcast.operators.rollup import product_info_first
    rows = [("a", 2, 1, "late"), ("a", 1, 2, "second"), ("a", 1, 1, "first"), ("b", None, 1, "null first"),
            ("c", 7, 7, None), (None, 0, 0, "no key")]
    df = spark.createDataFrame(rows, "product_key string, o1 long, o2 long, v string")
    out = product_info_first(df, ["v"], ["o1", "o2"])
    assert {r.product_key: r.v for r in out.collect()} == {"a": "first", "b": "null first", "c": None}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_distinct_counts_do_not_share_a_task_with_a_join(spark):
    # an entry per distinct value came on top of the sorts of the join before; a hot key stays spread
    from pyspark.sql import functions as F

    from retailcast.operators.rollup import monthly_rollup
    lines = spark.range(300).selectExpr("id", "IF(id % 3 = 0, NULL, id % 50) AS o", "IF(id < 290, 'a', 'b') AS k",
                                        "date_add(DATE'2024-01-01', CAST(id % 60 AS INT)) AS d")
    joined = lines.join(lines.select(F.col("id").alias("other")).hint("shuffle_merge"), F.col("id") == F.col("other"))
    out = monthly_rollup(joined, "d", ["k"], {"o": "nunique", "id": "count", "*": "size"})
    steps = [x.strip(" :+-*()0123456789") for x in out._jdf.queryExecution().executedPlan().toString().splitlines()]
    above = steps[:next(i for i, x in enumerate(steps) if x.startswith("SortMergeJoin"))]
    last = [x.split()[0] for x in above if x.startswith(("HashAggregate", "Exchange"))][-1]
    assert last == "Exchange"
    rows = [(r["id"], r["o"], r["k"], r["d"]) for r in lines.collect()]
    want = {}
    for i, o, k, d in rows:
        own = want.setdefault((d.strftime("%Y-%m"), k), [set(), 0])
        own[0] |= {o} - {None}
        own[1] += 1
    assert {(r.month, r.k): (r.o, r.id, r.row_count) for r in out.collect()} == {
        x: (len(s), n, n) for x, (s, n) in want.items()}
