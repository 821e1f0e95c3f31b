"""Exact distributed medians against numpy, with skew and infinities."""

import math
import random

import numpy as np
import pytest

from retailcast.operators.medians import column_medians


def test_medians_match_numpy(spark):
    rnd = random.Random(3)
    a = [rnd.gauss(0, 1) * 10 ** rnd.randint(0, 6) for _ in range(3001)]
    b = [7.0] * 1000 + [rnd.random() for _ in range(2000)]  # one value holds a third of the rows
    c = [None if i % 3 == 0 else float(i % 17) for i in range(3000)]
    rows = [(a[i], b[i] if i < len(b) else None, c[i] if i < len(c) else None) for i in range(3001)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = column_medians(df, ["a", "b", "c"])
    assert got["a"] == float(np.median(a))
    assert got["b"] == float(np.median(b))
    assert got["c"] == float(np.median([x for x in c if x is not None]))


def test_medians_with_infinities(spark):
    vals = [1.0, 2.0, math.inf, math.inf, None, 3.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    # pandas order: [1, 2, 3, inf, inf] -> the middle value 3.0
    assert column_medians(df, ["x"], count_infinite=True)["x"] == 3.0
    even = spark.createDataFrame([(v,) for v in [1.0, math.inf, 5.0, math.inf]], "x double")
    assert column_medians(even, ["x"], count_infinite=True)["x"] == math.inf
    assert column_medians(df, ["x"], count_infinite=False)["x"] == 2.0
    empty = spark.createDataFrame([(None,)], "x double")
    assert column_medians(empty, ["x"])["x"] is None


def test_approx_medians_close(spark):
    from retailcast.operators.medians import approx_medians
    rnd = random.Random(5)
    vals = [rnd.random() * 100 for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = approx_medians(df, ["x"], accuracy=10000)["x"]
    rank = sum(v < got for v in vals)
    assert abs(rank - len(vals) / 2) <= len(vals) / 10000 + 1


def test_grouped_medians(spark):
    import statistics

    from pyspark.sql import functions as F

    from retailcast.operators.medians import grouped_medians
    rnd = random.Random(8)
    rows = [("hot", rnd.gauss(0, 1) * 10 ** rnd.randint(-3, 6), float(rnd.randint(0, 3))) for _ in range(3000)]
    rows += [(f"g{i % 40}", rnd.random(), None if i % 3 else 1e300 * rnd.choice([-1, 1])) for i in range(400)]
    rows += [(None, 2.0, math.nan), (None, 4.0, math.inf), ("inf", -math.inf, math.inf), ("inf", math.inf, 1.0), ("inf", math.inf, 1.0),
             ("tiny", 0.0, -0.0), ("tiny", 5e-324, 0.0), ("tiny", 1e-323, 0.0), ("none", None, math.nan)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    for buckets in (64, 1024):
        got = {r["g"]: (r["a"], r["b"]) for r in grouped_medians(df, ["g"], ["a", "b"], buckets).collect()}
        assert set(got) == {r[0] for r in rows}
        for g, pair in got.items():
            for k, value in enumerate(pair, 1):
                xs = [r[k] for r in rows if r[0] == g and r[k] is not None and not math.isnan(r[k])]
                want = statistics.median(xs) if xs else None
                assert value == want or value == pytest.approx(want, rel=1e-15)
        if buckets == 64:
            df = df.repartition(5).where(F.lit(True))
    assert grouped_medians(df.limit(0), ["g"], ["a"]).collect() == []


def test_medians_of_a_table_without_keys(spark):
    from retailcast.operators.medians import grouped_medians
    df = spark.createDataFrame([(float(i), "x.y") for i in range(7)], "`v.w` double, `k.l` string")
    assert [tuple(r) for r in grouped_medians(df, ["k.l"], ["v.w"]).collect()] == [("x.y", 3.0)]
