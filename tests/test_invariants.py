"""Invariants on the derived test tables (sf0.001)."""

from pyspark.sql import functions as F

from retailcast.catalog import _forecast, _monthly, _traffic_m
from retailcast.operators.allocate import allocate_traffic, month_share
from retailcast.operators.rollup import TrafficSpec

SF = "/root/testdata/sf0.001"


def test_shares_sum_to_one(spark):
    s = month_share(_monthly(spark, SF)).groupBy("month").agg(F.sum("weight").alias("s"))
    assert all(abs(r.s - 1.0) < 1e-9 for r in s.collect())


def test_apportioned_counts(spark):
    a = allocate_traffic(_monthly(spark, SF), _traffic_m(spark, SF), cutoff="1900-01-01")
    t = _traffic_m(spark, SF)
    for c in TrafficSpec().counts:
        per = a.groupBy("month").agg(F.sum(c).alias("got"), F.min(c).alias("lo"), F.count(F.lit(1)).alias("n"))
        j = per.join(t.select("month", F.col(c).alias("total")), "month")
        for r in j.collect():
            if r.total == 0:
                assert r.got == 0
                continue
            assert r.lo >= 1
            assert r.total <= r.got <= r.total + 2 * r.n   # a pre-floor part is >= -1: the floor adds <= 2 a row
            if r.lo > 1:                                # no part at the floor: nothing was lifted
                assert r.got == r.total, (c, r)


def test_forecasts_whole_and_non_negative(spark):
    f = _forecast(spark, SF, "core")
    # only products without any history value have no forecast
    known = F.col("feature_mean_qty_per_product").isNotNull()
    bad = f.where((F.col("forecast") < 0) | (F.col("forecast").isNull() == known)).count()
    assert bad == 0 and f.count() > 0
