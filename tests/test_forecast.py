"""The all-product recursive forecast against a per-product Python loop."""

import datetime as dt

from retailcast.plans.forecast import DEFAULT_LINEAR, forecast_recursive


def add_months(d, k):
    m = d.month - 1 + k
    return dt.date(d.year + m // 12, m % 12 + 1, 1)


def loop(hist, mode, n, w):
    """hist: list of (month, qty, growth, orders) sorted by month."""
    vals = [q for _, q, _, _ in hist if q is not None]
    mean = sum(vals) / len(vals)
    growth = sum(g for _, _, g, _ in hist) / len(hist)
    orders = sum(o for _, _, _, o in hist) / len(hist)
    by_m = {}
    for m, q, _, _ in hist:
        if q is not None:
            by_m.setdefault(m.month, []).append(q)
    seas = {k: (sum(v) / len(v)) / mean if mean > 0 else 1.0 for k, v in by_m.items()}
    last = max(m for m, _, _, _ in hist)
    seq, out = list(vals), []
    for i in range(1, n + 1):
        month = add_months(last, i)
        s = seas.get(month.month, 1.0)
        c = len(seq)
        if mode == "core":
            rolling = sum(seq[-3:]) / len(seq[-3:]) if c < 3 else ((seq[-3] + seq[-2]) + seq[-1]) / 3.0
        else:
            rolling = ((seq[-3] + seq[-2]) + seq[-1]) / 3.0 if c >= 3 else mean
        trend = max(0.0, (seq[-1] - seq[-3]) / 2.0 if c >= 3 else (seq[-1] - seq[-2] if c == 2 else 0.0))
        f = {"rolling_3m_qty": rolling, "mean_qty_per_product": mean, "lag_1_qty": seq[-1],
             "seasonal_index": s, "trend_qty": trend, "lag_2_qty": seq[-2] if c >= 2 else 0.0,
             "mom_growth_qty": growth * 0.8 if mode == "core" else growth,
             "lag_3_qty": seq[-3] if c >= 3 else 0.0,
             "total_orders": orders * s if mode == "core" else orders}
        raw = sum(w[k] * v for k, v in f.items())
        pred = max(0, round(raw))
        out.append((month, pred))
        seq.append(float(pred))
    return out


def test_forecast_matches_loop(spark):
    d = dt.date
    hist = {"a": [(d(2024, 1, 1), 3, 0.0, 1.0), (d(2024, 2, 1), 5, 0.5, 1.0), (d(2024, 4, 1), 8, 0.2, 1.0),
                  (d(2024, 5, 1), 2, -0.7, 1.0)],
            "b": [(d(2023, 11, 1), 10, 0.0, 1.0)],
            "c": [(d(2024, 3, 1), 4, 0.0, 1.0), (d(2024, 6, 1), 9, 1.25, 1.0)]}
    rows = [(k, m, q, g, o) for k, hs in hist.items() for m, q, g, o in hs]
    df = spark.createDataFrame(rows, "product_key string, month date, total_qty long, mom_growth_qty double, "
                                     "total_orders double")
    for mode in ("core", "plain"):
        got = {}
        for r in forecast_recursive(df, 5, mode=mode).collect():
            got.setdefault(r.product_key, []).append((r.month, r.forecast))
        for k, hs in hist.items():
            assert sorted(got[k]) == loop(hs, mode, 5, DEFAULT_LINEAR.weights), (mode, k)


def test_forecast_with_mllib_scorer(spark):
    """A fitted GBT pipeline scores each step over the nine feature columns."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from retailcast.plans.core_table import MODEL_FEATURES
    rows = [tuple(float((i * (j + 3)) % 7) for j in range(9)) + (float(i % 7),) for i in range(60)]
    train = spark.createDataFrame(rows, ", ".join(f"f_{c} double" for c in MODEL_FEATURES) + ", y double")
    va = VectorAssembler(inputCols=[f"f_{c}" for c in MODEL_FEATURES], outputCol="features")
    model = GBTRegressor(featuresCol="features", labelCol="y", maxIter=3, maxDepth=2, seed=1).fit(va.transform(train))
    d = dt.date
    hist = [("a", d(2024, 1, 1), 3, 0.0, 1.0), ("a", d(2024, 2, 1), 5, 0.5, 1.0), ("b", d(2024, 1, 1), 2, 0.0, 1.0)]
    df = spark.createDataFrame(hist, "product_key string, month date, total_qty long, mom_growth_qty double, "
                                     "total_orders double")
    out = forecast_recursive(df, 3, scorer=model).collect()
    assert len(out) == 6
    assert all(r.forecast >= 0 and isinstance(r.forecast, int) for r in out)
    assert sorted({r.step for r in out}) == [1, 2, 3]


HISTORY = "product_key string, month date, total_qty long, mom_growth_qty double, total_orders double"


def test_products_without_any_value_keep_their_rows(spark):
    d = dt.date
    df = spark.createDataFrame([("a", d(2024, 1, 1), 3, 0.0, 1.0), ("b", d(2024, 1, 1), None, None, None),
                                ("b", d(2024, 3, 1), None, None, None)], HISTORY)
    for mode in ("core", "plain"):
        got = {(r.product_key, r.month): r.forecast for r in forecast_recursive(df, 2, mode=mode).collect()}
        assert got[("b", d(2024, 4, 1))] is None and got[("b", d(2024, 5, 1))] is None
        assert got[("a", d(2024, 2, 1))] >= 0 and len(got) == 4


def test_failed_score_falls_back_to_the_product_mean(spark):
    from retailcast.plans.forecast import LinearScorer
    d = dt.date
    df = spark.createDataFrame([("a", d(2024, 1, 1), 3, None, 1.0), ("a", d(2024, 2, 1), 6, None, 1.0)], HISTORY)
    strict = LinearScorer(DEFAULT_LINEAR.weights, missing_fails=True)
    assert [r.forecast for r in forecast_recursive(df, 3, scorer=strict, mode="plain").collect()] == [4, 4, 4]
    assert [r.forecast for r in forecast_recursive(df, 2, scorer=strict, mode="core").collect()] == [0, 0]


def test_linear_forecast_needs_no_checkpoint(spark):
    d = dt.date
    df = spark.createDataFrame([("a", d(2024, 1, 1), 3, 0.0, 1.0)], HISTORY)
    plan = forecast_recursive(df, 24)._jdf.queryExecution().toString()
    assert "Scan ExistingRDD" not in plan.split("Physical Plan")[-1].replace("Scan ExistingRDD[product_key", "")
    assert forecast_recursive(df, 24).count() == 24


def test_train_save_load_forecast(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from retailcast.plans.core_table import MODEL_FEATURES
    from retailcast.plans.train import score, train_gbt
    rows = [tuple(float((i * (j + 3)) % 7) for j in range(9)) + (float(i % 7),) for i in range(60)]
    train = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in MODEL_FEATURES) + ", total_qty double")
    model = train_gbt(train, maxIter=5)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    d = dt.date
    df = spark.createDataFrame([("a", d(2024, 1, 1), 3, 0.0, 1.0), ("a", d(2024, 2, 1), 5, 0.5, 1.0),
                                ("b", d(2024, 1, 1), 2, None, None), ("c", d(2024, 1, 1), None, None, None)], HISTORY)
    a, b = (sorted(map(tuple, forecast_recursive(df, 3, scorer=m).collect())) for m in (model, loaded))
    assert len(a) == 9 and str(a) == str(b)   # str: a NULL feature is one value, NaN or not
    gaps = spark.createDataFrame([(None, *rows[0][1:])] + rows[:3], train.schema)
    assert score(model, gaps).count() == 4   # a row with a missing feature is scored, not dropped
