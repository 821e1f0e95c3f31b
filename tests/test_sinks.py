"""Sinks: table round trip, model persistence, time-stamped forecast export."""

import datetime as dt
import os

from retailcast.plans.train import score, train_gbt
from retailcast.sources.readers import read_table
from retailcast.sources.sinks import export_forecasts, load_model, save_model, write_table


def test_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-02", 3), ("a", "2024-01", 1)], "product_key string, month string, qty long")
    p = str(tmp_path / "t")
    write_table(df, p, fmt="csv", sort_within=["product_key", "month"])
    back = read_table(spark, p, fmt="csv", month_col="month")
    rows = sorted((r.product_key, r.month, int(r.qty), r.month_date) for r in back.collect())
    assert rows == [("a", "2024-01", 1, dt.date(2024, 1, 1)), ("a", "2024-02", 3, dt.date(2024, 2, 1))]


def test_model_and_export(spark, tmp_path):
    rows = [(float(i % 5), float(i % 3), float(i % 5) * 2 + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, total_qty double")
    m = train_gbt(df, features=["a", "b"], maxIter=3)
    p = str(tmp_path / "model")
    save_model(m, p)
    again = load_model(p)
    x = sorted(r.prediction for r in score(m, df).collect())
    y = sorted(r.prediction for r in score(again, df).collect())
    assert x == y
    path = export_forecasts(df.limit(3), str(tmp_path), now=dt.datetime(2025, 1, 2, 3, 4, 5))
    assert path.endswith("forecast_20250102_030405") and os.path.isdir(path)


def test_grid_search(spark):
    from retailcast.plans.train import grid_search
    rows = [(float(i % 7), float(i % 4), float(i % 7) * 3 + (i % 4)) for i in range(80)]
    df = spark.createDataFrame(rows, "a double, b double, total_qty double")
    cv = grid_search(df, {"maxDepth": [1, 2], "maxIter": [2]}, features=["a", "b"], folds=2)
    assert len(cv.avgMetrics) == 2
    assert min(cv.avgMetrics) == cv.avgMetrics[1]  # the deeper trees fit this better


def test_ordered_output(spark, tmp_path):
    from retailcast.sources.sinks import write_table
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k long, v long").repartition(5)
    write_table(df, str(tmp_path / "t"), fmt="csv", sort_by=["k"])
    files = sorted((tmp_path / "t").glob("part-*.csv"))
    keys = [int(line.split(",")[0]) for f in files for line in f.read_text().splitlines()[1:]]
    assert keys == sorted(keys) and len(keys) == 101


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F
    p = str(tmp_path / "t")
    assert write_table(spark.range(100), p) == 100
    bad = spark.range(1000).repartition(8).select(
        F.when(F.col("id") == 777, F.raise_error(F.lit("half way"))).otherwise(F.col("id")).cast("long").alias("id"))
    for fmt in ("parquet", "csv"):
        with pytest.raises(Exception, match="half way"):
            write_table(bad, p, fmt=fmt)
        assert spark.read.parquet(p).count() == 100
        assert os.listdir(tmp_path) == ["t"]


def test_a_table_replaces_itself(spark, tmp_path):
    p = str(tmp_path / "t")
    write_table(spark.range(50), p)
    again = spark.read.parquet(p)
    assert write_table(again.unionByName(spark.range(50, 60)), p) == 60   # reads the old one while it writes
    assert spark.read.parquet(p).count() == 60 and os.listdir(tmp_path) == ["t"]


def test_lost_files_are_noticed(spark, tmp_path, monkeypatch):
    import pytest

    from retailcast.sources import sinks
    p = str(tmp_path / "t")
    write_table(spark.range(10), p)
    monkeypatch.setattr(sinks, "COUNTED", ("parquet",))
    monkeypatch.setattr(sinks.Observation, "get", property(lambda self: {"rows": 11}))
    with pytest.raises(OSError, match="10 of 11"):
        write_table(spark.range(10), p)
    assert spark.read.parquet(p).count() == 10


def test_quotes_and_commas_survive_csv(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c', 1), ("back\\slash", 2), ("", 3), ("é", 4), ("  spaced - ", 5)], "s string, n long")
    write_table(df, str(tmp_path / "t"), fmt="csv")
    got = {int(r.n): r.s for r in read_table(spark, str(tmp_path / "t"), fmt="csv").collect()}
    assert got[1] == 'a "b", c' and got[2] == "back\\slash" and got[4] == "é" and got[5] == "  spaced - "
