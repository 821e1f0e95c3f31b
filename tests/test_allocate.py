"""Whole-number apportioning against a plain sequential restatement."""

import random

from retailcast.operators.allocate import apportion_counts


def sequential(total, weights, keys, min_val=1):
    """Round each share half-even, hand out the remainder one unit at a time
    in descending weight (ties: key ascending), cycling; floor at min_val."""
    if total is None or total == 0 or sum(weights) == 0:
        return [0] * len(weights)
    s = sum(weights)
    parts = [round(total * (w / s)) for w in weights]  # Python round is half-even
    diff = total - sum(parts)
    order = sorted(range(len(weights)), key=lambda i: (-weights[i], keys[i]))
    step = 1 if diff > 0 else -1
    for i in range(abs(diff)):
        parts[order[i % len(order)]] += step
    return [max(p, min_val) for p in parts]


def test_apportion_matches_sequential(spark):
    rnd = random.Random(7)
    rows, expect = [], {}
    for m in range(40):
        n = rnd.randint(1, 9)
        total = rnd.choice([0, None, rnd.randint(1, 5), rnd.randint(1, 200), n * 3])
        weights = [rnd.choice([0, 1, 2, 5, 10, 10, rnd.randint(1, 1000)]) for _ in range(n)]
        if m % 7 == 0:
            weights = [0] * n
        keys = [f"p{j:02d}" for j in range(n)]
        for k, w in zip(keys, weights):
            rows.append((m, k, w, total))
        for k, v in zip(keys, sequential(total, weights, keys)):
            expect[(m, k)] = v
    df = spark.createDataFrame(rows, "month int, product_key string, w long, total long")
    out = apportion_counts(df, {"part": "total"}, weight="w")
    got = {(r["month"], r["product_key"]): r["part"] for r in out.collect()}
    assert got == expect


def test_apportion_edges(spark):
    df = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 1, 2), (1, "c", 1, 2)], "month int, product_key string, w long, total long")
    parts = sorted(r["part"] for r in apportion_counts(df, {"part": "total"}, weight="w").collect())
    assert parts == [1, 1, 1]  # total < rows: the floor lifts the zero part, sum exceeds the total
    df = spark.createDataFrame([(1, "a", 3, 9), (1, "b", 3, 9), (1, "c", 3, 9)], "month int, product_key string, w long, total long")
    assert sorted(r["part"] for r in apportion_counts(df, {"part": "total"}, weight="w").collect()) == [3, 3, 3]


def test_rank_in_hot_group(spark):
    from pyspark.sql import functions as F

    from retailcast.operators.allocate import rank_in_group
    rnd = random.Random(11)
    rows = [(1, f"k{i:05d}", rnd.randint(0, 50)) for i in range(3000)] + [(2, f"k{i:05d}", i) for i in range(10)]
    df = spark.createDataFrame(rows, "month int, product_key string, w long")
    got = {(r["month"], r["product_key"]): r["__rank"] for r in
           rank_in_group(df, "month", [F.col("w").desc(), F.col("product_key").asc()]).collect()}
    for m in (1, 2):
        ordered = sorted((r for r in rows if r[0] == m), key=lambda r: (-r[2], r[1]))
        assert [got[(m, r[1])] for r in ordered] == list(range(len(ordered)))
