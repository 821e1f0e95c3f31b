"""Regularised boosting against a plain restatement; ensembles as one expression."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailcast.plans import boosting as B

FEATURES = ["a", "b", "c d"]


def data(seed, n=400, missing=0.1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [float(rng.randint(0, 9)), round(rng.gauss(0, 2), 1), float(rng.randint(0, 3))]
        y = 3 * (x[0] > 4) + x[1] + (x[2] == 2) * 5 + rng.gauss(0, 0.3)
        x = [rng.choice([None, math.nan]) if rng.random() < missing else v for v in x]
        rows.append((*x, y if i % 50 else None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "a double, b double, `c d` double, y double")


def missing(v):
    return v is None or math.isnan(v)


def grow(rows, p, s, depth, node=0, nodes=None):
    """A tree over rows (x, y) and predictions, thresholds at all values: {node: (feature, threshold, missing left) or value}."""
    nodes = {} if nodes is None else nodes
    g, n = sum(q - y for (_, y), q in zip(rows, p)), len(rows)

    def score(g, n):
        return max(abs(g) - s.l1, 0) ** 2 / (n + s.l2) if n + s.l2 else 0.0

    best = None
    for f in range(len(rows[0][0])) if depth else ():
        values = sorted({x[f] for x, _ in rows if not missing(x[f])})
        for v in values[:-1] if len(values) == len(rows) or not any(missing(x[f]) for x, _ in rows) else values:
            for left_missing in (0, 1):
                if left_missing and not any(missing(x[f]) for x, _ in rows):
                    continue
                left = [(x[f] <= v) if not missing(x[f]) else bool(left_missing) for x, _ in rows]
                nl = sum(left)
                if nl < s.min_child or n - nl < s.min_child:
                    continue
                gl = sum(q - y for ((_, y), q), l in zip(zip(rows, p), left) if l)
                gain = score(gl, nl) + score(g - gl, n - nl) - score(g, n)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, v, left_missing, left)
    if not best:
        nodes[node] = -math.copysign(max(abs(g) - s.l1, 0), g) / (n + s.l2) * s.rate
        return nodes
    _, f, v, left_missing, left = best
    nodes[node] = (f, v, left_missing)
    for side, child in ((True, 2 * node + 1), (False, 2 * node + 2)):
        grow([r for r, l in zip(rows, left) if l == side], [q for q, l in zip(p, left) if l == side], s, depth - 1, child, nodes)
    return nodes


def answer(nodes, x):
    node = 0
    while isinstance(nodes[node], tuple):
        f, v, left_missing = nodes[node]
        right = (not left_missing) if missing(x[f]) else x[f] > v
        node = 2 * node + 1 + right
    return nodes[node]


def plain(rows, s):
    rows = [(r[:3], r[3]) for r in rows if r[3] is not None]
    base = sum(y for _, y in rows) / len(rows)
    p, trees = [base] * len(rows), []
    for _ in range(s.trees):
        trees.append(grow(rows, p, s, s.depth))
        p = [q + answer(trees[-1], x) for q, (x, _) in zip(p, rows)]
    return base, trees


@pytest.mark.parametrize("seed,settings", [(1, B.BoostSettings(trees=12, depth=2, rate=0.3)),
                                           (2, B.BoostSettings(trees=3, depth=3, l1=4.0, l2=20.0, min_child=9))])
def test_equals_the_plain_restatement(spark, seed, settings):
    rows = data(seed)
    df = frame(spark, rows).repartition(3)
    model = B.train_boosted(df, FEATURES, "y", settings)
    base, trees = plain(rows, settings)
    assert model.base == pytest.approx(base, rel=1e-9)
    for k, nodes in enumerate(trees):
        got = {s["node"]: s for s in model.stats if s["round"] == k}
        assert set(got) == set(nodes)
        for n, want in nodes.items():
            if isinstance(want, tuple):
                assert (FEATURES.index(got[n]["feature"]), got[n]["threshold"]) == want[:2]
            else:
                assert got[n]["value"] == pytest.approx(want, abs=1e-6)
    scored = model.transform(df.withColumn("i", F.monotonically_increasing_id())).collect()
    for r in scored:
        x = [r[c] for c in FEATURES]
        assert r["prediction"] == pytest.approx(base + sum(answer(t, x) for t in trees), abs=1e-5)


def test_does_not_depend_on_partitions(spark):
    rows = data(5)
    s = B.BoostSettings(trees=4, depth=3)
    models = [B.train_boosted(frame(spark, rows).repartition(k), FEATURES, "y", s) for k in (1, 7)]
    assert models[0] == models[1]


def test_many_values_get_quantile_bins(spark):
    df = spark.range(4000).select((F.col("id") * 1.5).alias("a"), (F.col("id") % 3).cast("double").alias("b"),
                                  F.lit(None).cast("double").alias("c d"), (F.col("id") > 1999).cast("double").alias("y"))
    edges = B.bin_edges(df, FEATURES, 64)
    assert 40 <= len(edges[0]) <= 63 and edges[1] == [0.0, 1.0] and edges[2] == []
    model = B.train_boosted(df, FEATURES, "y", B.BoostSettings(trees=2, depth=2), 64)
    split = model.stats[0]
    assert split["feature"] == "a" and abs(split["threshold"] - 3000) < 100


def test_bin_numbers(spark):
    edges = [1.0, 2.0, 2.5, 9.0, 10.0]
    values = [None, math.nan, -math.inf, 0.0, 1.0, 1.5, 2.0, 2.2, 2.5, 9.5, 10.0, 11.0, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.selectExpr(B.bin_number("v", edges)).collect()]
    assert got == [0 if missing(v) else 1 + sum(e < v for e in edges) for v in values]


def test_models_grow_together_as_alone(spark):
    rows = data(7)
    df = frame(spark, rows).withColumn("fold", F.pmod(F.hash("a", "b"), F.lit(2)))
    settings = [B.BoostSettings(trees=3, depth=2), B.BoostSettings(trees=2, depth=1, l2=9.0)]
    both, preds = B.boost(df, FEATURES, "y", [(settings[0], 0), (settings[1], None), (settings[0], 1)], "fold")
    alone = B.train_boosted(df, FEATURES, "y", settings[1])
    assert [s["threshold"] for s in both[1].stats] == [s["threshold"] for s in alone.stats]
    held = [s["n_rows"] for s in both[0].stats if s["node"] == 0][0]
    assert held == df.where("fold <> 0 AND y IS NOT NULL").count()
    assert preds.count() == df.where("y IS NOT NULL").count() and len(preds.first()["preds"]) == 3


def test_grid_search_finds_the_planted_depth(spark):
    rng = random.Random(3)
    rows = [(float(rng.randint(0, 1)), float(rng.randint(0, 1)), 0.0, i) for i in range(600)]
    df = frame(spark, [(a, b, c, 10.0 * (a != b) + 0.5 * a) for a, b, c, _ in rows]).withColumn("k", F.monotonically_increasing_id())
    found = B.grid_search(df, {"depth": [1, 2]}, FEATURES, "y", folds=3, keys=["k"],
                          base=B.BoostSettings(trees=6, rate=0.5, l1=0.0))
    assert found.best.depth == 2 and found.mean_rmse[1] < found.mean_rmse[0] / 2
    sizes = {(r["setting"], r["fold"]): (r["n_train"], r["n_held_out"]) for r in found.scores.collect()}
    assert len(sizes) == 6 and all(a + b == 600 for a, b in sizes.values())
    assert sum(sizes[0, f][1] for f in range(3)) == 600
    assert found.model.trees == 6


def test_saved_ensemble(spark, tmp_path):
    model = B.train_boosted(frame(spark, data(9)), FEATURES, "y", B.BoostSettings(trees=2))
    model.save(spark, str(tmp_path / "m"))
    assert B.Ensemble.load(spark, str(tmp_path / "m")) == model


def test_odd_training_tables(spark):
    empty = B.train_boosted(frame(spark, []), FEATURES, "y", B.BoostSettings(trees=2))
    one = B.train_boosted(frame(spark, [(1.0, 2.0, 3.0, 5.0)] * 3), FEATURES, "y", B.BoostSettings(trees=2))
    df = frame(spark, [(None, math.nan, 1.0, None)])
    assert [m.transform(df).first()["prediction"] for m in (empty, one)] == [0.0, 5.0]


def test_mllib_trees_as_one_expression(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
    rows = [r for r in data(11, missing=0.0) if r[3] is not None]
    df = frame(spark, rows).repartition(2)
    va = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    probe = frame(spark, [r[:3] + (0.0,) for r in data(12)])
    for kind in (GBTRegressor(labelCol="y", maxIter=6, maxDepth=3, stepSize=0.2), DecisionTreeRegressor(labelCol="y", maxDepth=4)):
        model = kind.fit(va.transform(df))
        got = B.ensemble_of(model, FEATURES).transform(model.transform(va.transform(probe)).withColumnRenamed("prediction", "own"))
        assert all(r["prediction"] == pytest.approx(r["own"], rel=1e-12) for r in got.collect())


def test_expression_stays_small(spark):
    rng = np.random.default_rng(0)
    big = B.Ensemble(FEATURES, 3, 1.0, rng.integers(0, 3, 2100).tolist(), rng.random(2100).tolist(), [0] * 2100, rng.random(2400).tolist())
    df = big.transform(frame(spark, data(1)))
    assert big.trees == 300 and df.count() == 400
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("element_at") + plan.count("CASE WHEN") < 50


def test_exact_sums_of_whole_numbers():
    rng = np.random.default_rng(1)
    at = rng.integers(0, 5, 20_000)
    for top in (1 << 20, 1 << 45, 1 << 47):
        g = rng.integers(-top, top, 20_000)
        assert B.exact_sums(at, g, 6).tolist() == [sum(int(v) for v in g[at == i]) for i in range(6)]
    assert B.exact_sums(at[:0], g[:0], 2).tolist() == [0, 0]
    many = np.full((1 << 20) + 3, (1 << 40) + 1)
    assert B.exact_sums(np.zeros(len(many), int), many, 1).tolist() == [len(many) * ((1 << 40) + 1)]
    assert B.whole_gradients(np.array([0.5, -0.5, 2.5, -1.4, 0.49999999999999994])).tolist() == [1, -1, 3, -1, 0]


def test_rows_are_not_multiplied_by_models_and_features(spark, monkeypatch):
    # a level of 12 models x 4 features made 48 rows of each row before they were added up
    df = frame(spark, data(7))
    plans, own = [], type(df).toArrow

    def seen(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return own(self)

    monkeypatch.setattr(type(df), "toArrow", seen)
    B.boost(df.withColumn("f", F.pmod(F.hash("y"), F.lit(2))), FEATURES, "y", [(B.BoostSettings(trees=1, depth=2), i) for i in (0, 1)], "f")
    assert len(plans) == 2 and not any("Generate" in p for p in plans)


def test_rows_without_a_fold_train_nothing(spark):
    rows = [(float(i % 4), 0.0, 0.0, float(i % 4 > 1) * 8, None if i % 4 == 3 else i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, `c d` double, y double, f int")
    (model,), left = B.boost(df, FEATURES, "y", [(B.BoostSettings(trees=1, depth=1), 1)], "f")
    assert sorted({s["n_rows"] for s in model.stats}) == [10, 20]
    assert left.count() == 40 and left.where("fold IS NULL").count() == 10
