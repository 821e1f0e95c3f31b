"""The features are computed once, whatever reads them afterwards."""

import datetime

import pytest
from pyspark.sql import functions as F

from retailcast import catalog
from retailcast.plans.core_table import MODEL_FEATURES
from retailcast.plans.forecast import forecast_recursive
from retailcast.plans.train import train_gbt

ROWS = [(f"p{p}", f"{2020 + m // 12}-{m % 12 + 1:02d}", (p * 7 + m * 3) % 11) for p in range(6) for m in range(20)]


def counted(spark):
    """(feature rows, how many of them were computed so far)."""
    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x

    df = spark.createDataFrame(ROWS, "product_key string, month string, n long").repartition(2)
    features = [(F.col("n") * (i + 1) % 7).cast("double").alias(c) for i, c in enumerate(MODEL_FEATURES)]
    return df.select("product_key", "month", F.udf(note, "long")("n").alias("total_qty"), *features), seen


@pytest.mark.parametrize("name", ["boosted_metrics", "gbt_metrics", "forecast_gbt", "saved_model_forecast"])
def test_queries_compute_the_features_once(spark, monkeypatch, name):
    rows, seen = counted(spark)
    monkeypatch.setattr(catalog, "_core_features", lambda *_: rows)
    monkeypatch.setattr(catalog, "_MODELS", {})
    monkeypatch.setattr(catalog, "train_gbt", lambda t: train_gbt(t, maxIter=2))
    assert catalog.QUERIES[name](spark, "nowhere").count() == (36 if "forecast" in name else 1)
    assert seen.value == len(ROWS)


def test_a_forecast_computes_its_history_once(spark):
    rows, seen = counted(spark)
    history = rows.select("product_key", F.to_date(F.concat("month", F.lit("-01"))).alias("month"), "total_qty",
                          "mom_growth_qty", "total_orders")
    got = forecast_recursive(history, 2).collect()
    assert len(got) == 12 and {r["month"] for r in got} == {datetime.date(2021, 9, 1), datetime.date(2021, 10, 1)}
    assert seen.value == len(ROWS)
