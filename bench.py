"""Benchmark the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is planned and executed in full (``noop`` sink: every row is
computed, nothing is collected). Times are wall seconds per query, after one
untimed warm-up query that starts the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("retailcast-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", str(2 * cpus))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-checkpoints-"))
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from retailcast.catalog import QUERIES, _history, _training
    from retailcast.plans.forecast import DEFAULT_LINEAR, forecast_recursive
    from retailcast.plans.feature_table import feature_table
    from retailcast.plans.train import train_gbt, train_test_split
    from retailcast.sources.fixtures import Fixtures

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    run(QUERIES["monthly_product_sales"](spark, sf_dir))  # warm-up, untimed

    def forecast_12(spark, sf):
        return forecast_recursive(_history(spark, sf), 12, scorer=DEFAULT_LINEAR, mode="core")

    def gbt_fit(spark, sf):
        t = train_test_split(_training(spark, sf), ["product_key", "month"])
        train_gbt(t.where("is_train"))   # all 300 trees
        return None

    def by_part(spark, sf):
        # the product key grows with the data: part number as variant
        from pyspark.sql import functions as F
        fx = Fixtures(spark, sf)
        sales = fx.sales().withColumn("variant", F.col("src_partkey").cast("string"))
        return feature_table(sales, fx.traffic("1995-04-01"), fx.stock_status(), fx.holidays())

    plan = [
        ("monthly_product_sales", QUERIES["monthly_product_sales"]),
        ("estimate_missing_traffic", QUERIES["estimate_missing_traffic"]),
        ("feature_table", QUERIES["feature_table"]),
        ("core_features", QUERIES["core_features"]),
        ("forecast_recursive_12", forecast_12),
        ("feature_table_by_part", by_part),
        ("gbt_fit_300_trees", gbt_fit),
        ("compare_values", QUERIES["compare_values"]),
    ]
    times = {}
    for name, fn in plan:
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if df is not None:
                run(df)
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 - one failing query must not hide the others
            print(f"bench: {name} failed: {type(e).__name__}: {str(e)[:500]}", file=sys.stderr)
            times[name] = None
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    done = [v for v in times.values() if v is not None]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(done), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus,
                      "failed": [k for k, v in times.items() if v is None]}))
    spark.stop()


if __name__ == "__main__":
    main()
