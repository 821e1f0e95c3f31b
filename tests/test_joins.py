"""safe_join: the tolerant equi-join rules."""

import pytest

from retailcast.operators.joins import safe_join


def test_safe_join_rules(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v long")
    right = spark.createDataFrame([("a", 10), (None, 20), ("d", 40)], "k string, v long")
    got = sorted(safe_join(left, right, ["k", "missing"], "left").collect(), key=lambda r: r.v_x)
    assert [(r.k, r.v_x, r.v_y) for r in got] == [("a", 1, 10), (None, 2, 20), ("c", 3, None)]  # NULL meets NULL
    outer = {(r.k, r.v_x, r.v_y) for r in safe_join(left, right, ["k"], "outer").collect()}
    assert ("d", None, 40) in outer and len(outer) == 4
    assert safe_join(left, right, ["k"], "sideways").count() == 3          # unknown how -> left
    assert safe_join(left, right, ["nope"], "inner") is left               # no common key -> unchanged
    with pytest.raises(ValueError):
        safe_join(left, right, ["k"], "cross")


def sides(spark):
    left = [(None, "n", i) for i in range(400)] + [(1, "a", i) for i in range(300)] + [(2, None, i) for i in range(200)]
    left += [(i, "x", i) for i in range(3, 60)]
    right = [(None, "n", -i) for i in range(30)] + [(1, "a", -i) for i in range(25)] + [(9, "y", -i) for i in range(40)]
    right += [(i, "x", -i) for i in range(3, 70, 2)] + [(3, "x", -99)]
    schema = "k long, `g h` string, v long"
    return spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema).repartition(2)


@pytest.mark.parametrize("how", ["left", "right", "outer", "inner"])
def test_hot_keys_give_the_same_rows(spark, how, monkeypatch):
    from retailcast.operators import joins, skew
    left, right = sides(spark)
    monkeypatch.setattr(joins, "split_join", lambda *a: skew.split_join(*a, rows_per_piece=17))
    plain = safe_join(left, right, ["k", "g h"], how)
    split = safe_join(left, right, ["k", "g h"], how, hot_share=0.05)
    assert split.columns == plain.columns
    assert split.exceptAll(plain).count() == 0 == plain.exceptAll(split).count()


def test_hot_keys_are_named_with_their_rows(spark):
    from retailcast.operators.skew import hot_keys, pieces
    left, right = sides(spark)
    hot = hot_keys(left, right, ["k", "g h"], 0.05)
    assert {x.key: (x.left, x.right) for x in hot} == {
        (None, "n"): (400, 30), (1, "a"): (300, 25), (2, None): (200, 0), (9, "y"): (0, 40)}
    assert hot[0].key == (None, "n") and hot[0].pairs == 12000
    assert pieces(hot[0], 100) == (4, 1) and hot_keys(left.limit(0), right.limit(0), ["k"], 0.05) == []
    assert hot_keys(left, right.withColumn("k", right.k.cast("int")), ["k"], 0.05) == []


def test_no_task_holds_a_hot_key(spark):
    from pyspark.sql import functions as F

    from retailcast.operators.skew import hot_keys, split_join
    left = spark.range(30000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.when(F.col("id") % 100 == 0, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("b"))
    was = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(was, ("-1", "false", "32")):
            spark.conf.set(c, v)
        out = split_join(left, right, ["k"], "inner", hot_keys(left, right, ["k"], 0.05), rows_per_piece=500)
        sizes = [r["count"] for r in out.where("l.k IS NULL").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 30000 and max(sizes) < 12000 and len(sizes) > 6
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)


def test_cells_are_bounded_by_their_pairs(spark):
    # millions of rows that meet a few thousand were one piece of each side
    from retailcast.operators.skew import MOST_CELLS, HotKey, hot_keys, pieces, split_join
    for left, right in ((3_000_000, 2250), (2250, 3_000_000), (200_000, 200_000), (10**6, 1)):
        a, b = pieces(HotKey(0, (), left, right), 1 << 20, 1 << 24)
        assert left * right / (a * b) <= 1 << 24 and (left == right or left * b + right * a < 2 * (left + right))
    a, b = pieces(HotKey(0, (), 10**9, 10**9), 1 << 20)
    assert a * b <= MOST_CELLS
    left = spark.range(4000).selectExpr("IF(id % 2 = 0, NULL, id) AS k", "id AS a")
    right = spark.range(100).selectExpr("IF(id % 2 = 0, NULL, id) AS k", "id AS b")
    out = split_join(left, right, ["k"], "inner", hot_keys(left, right, ["k"], 0.05), 1 << 20, 5000)
    tasks = out.where("l.k IS NULL").selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert sum(r["count"] for r in tasks) == 100_000 and max(r["count"] for r in tasks) <= 35_000 and len(tasks) >= 8


@pytest.mark.parametrize("how", ["left", "right", "outer", "inner"])
def test_rows_of_a_hot_key_are_stored_once(spark, how, monkeypatch):
    # a row was stored in every cell of its piece, and all hot rows in a checkpoint before
    from retailcast.operators import joins, skew
    left, right = sides(spark)
    kept, cut = [], skew.cut_lineage
    monkeypatch.setattr(skew, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    monkeypatch.setattr(skew, "RUN", 4)
    monkeypatch.setattr(skew, "LIST", 10)
    monkeypatch.setattr(joins, "split_join", lambda *a: skew.split_join(*a, rows_per_piece=100, pairs_per_cell=500))
    for l, r in ((left, right), (right, left)):   # either side may be the smaller one
        kept.clear()
        plain, split = safe_join(l, r, ["k", "g h"], how), safe_join(l, r, ["k", "g h"], how, hot_share=0.05)
        assert sum(x.selectExpr("sum(size(run))").first()[0] for x in kept) == 30 + 25
        plan = split._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("CartesianProduct") == 2 and "sequence(0" not in plan
        assert split.exceptAll(plain).count() == 0 == plain.exceptAll(split).count()


def test_many_hot_keys_and_columns_without_order(spark, monkeypatch):
    from retailcast.operators import skew
    left = spark.range(600).selectExpr("id % 6 AS k", "id % 2 AS a")      # equal rows
    right = spark.range(60).selectExpr("id % 6 AS k", "map('x', id % 20) AS b")
    hot = skew.hot_keys(left, right, ["k"], 0.05)
    assert len(hot) == 6 > skew.FEW
    out = skew.split_join(left, right, ["k"], "inner", hot, 30)
    want = left.join(right, "k").selectExpr("k", "a", "b['x'] AS b")
    assert out.selectExpr("l.k", "l.a", "r.b['x'] AS b").exceptAll(want).count() == 0 and out.count() == 6000 == want.count()
