"""Reference-shaped input tables derived from the TPC-H-like test tables.

The mapping is the one in FIXTURES.md §2. Every view is a lazy plan over the
parquet tables, so its size grows with them. ``retailcast.sources.fixture_sql``
holds the same views as DuckDB SQL for the oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.functions.keys import NO_VARIANT_LABEL, product_key
from retailcast.functions.text import (format_localized_cents, format_percent_bp,
                                       format_thousands)

# The first day with shop traffic in the derived tables.
TRAFFIC_START = "1995-04-01"
# Holiday (month, day, name) rows, repeated for 1995-2001.
HOLIDAY_DAYS = [
    (1, 1, "Tahun Baru"),
    (5, 1, "Hari Buruh"),
    (6, 1, "Hari Lahir Pancasila"),
    (8, 17, "Hari Kemerdekaan"),
    (12, 25, "Hari Natal"),
]
HOLIDAY_YEARS = (1995, 2001)
STOCK_DROP_MONTH = 7


class Fixtures:
    """Lazily built views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    # --- sales: one row per order line -----------------------------------
    def sales(self) -> DataFrame:
        li = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
        od = self.table("orders").select("o_orderkey", "o_orderdate")
        pt = self.table("part").select("p_partkey", "p_brand", "p_type", "p_size")
        j = (li.join(od, li.l_orderkey == od.o_orderkey)
               .join(pt, li.l_partkey == pt.p_partkey))
        qty = F.col("l_quantity").cast("long")
        net = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
        grams = (F.col("p_size") * 100).cast("long")
        return j.select(
            F.col("l_orderkey").alias("src_orderkey"),
            F.col("l_linenumber").alias("src_linenumber"),
            F.col("l_partkey").alias("src_partkey"),
            F.col("l_suppkey").alias("src_suppkey"),
            F.col("o_orderdate").alias("paid_at"),
            F.col("p_brand").alias("product"),
            F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string"))
             .otherwise(F.col("p_type")).alias("variant"),
            F.when(F.col("l_returnflag") == "R", F.lit("Batal"))
             .when(F.col("l_returnflag") == "N", F.lit("Selesai"))
             .otherwise(F.lit(None).cast("string")).alias("status"),
            qty.alias("qty"),
            F.col("l_extendedprice").alias("list_price"),
            net.alias("net_price"),
            F.concat(format_thousands(grams), F.lit(" gr")).alias("weight_text"),
            F.concat(format_thousands(grams * qty), F.lit(" gr")).alias("total_weight_text"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("seller_voucher"),
            (F.col("l_extendedprice") * F.col("l_discount") / F.lit(2.0)).alias("platform_voucher"),
            F.col("l_quantity").alias("coin_discount"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("shipping_fee"),
            (F.col("l_extendedprice") * F.col("l_tax") / F.lit(2.0)).alias("shipping_deduction"),
            F.when(F.col("l_returnflag") == "R", F.col("l_tax")).otherwise(F.lit(0.0)).alias("return_shipping"),
            (F.col("l_extendedprice") * F.col("l_tax") + F.lit(1.0)).alias("estimated_shipping"),
            (net * (F.lit(1.0) + F.col("l_tax"))).alias("total_payment"),
        )

    # --- traffic: one row per day ---------------------------------------
    def traffic(self, start: str | None = None) -> DataFrame:
        """Every day; from ``start`` on where the months before it shall lack traffic."""
        od = self.table("orders")
        if start:
            od = od.where(F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz"))
        cents = F.round(F.col("o_totalprice") * 100).cast("long")
        daily = od.groupBy(F.to_date("o_orderdate").alias("day")).agg(
            F.sum(cents).alias("sales_cents"),
            F.count(F.lit(1)).alias("orders"),
            F.count_distinct("o_custkey").alias("buyers"),
            F.sum(F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0)).cast("long").alias("new_buyers"),
            F.sum(F.when(F.col("o_custkey") % 3 == 1, 1).otherwise(0)).cast("long").alias("current_buyers"),
            F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("long").alias("cancelled_orders"),
            F.sum(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).cast("long").alias("returned_orders"),
            F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", cents)), F.lit(0)).alias("cancelled_cents"),
            F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "P", cents)), F.lit(0)).alias("returned_cents"),
        )
        return daily.select(
            F.date_format("day", "dd/MM/yyyy").alias("date_text"),
            format_localized_cents("sales_cents").alias("sales_text"),
            F.col("orders"),
            format_localized_cents(F.expr("sales_cents div orders")).alias("sales_per_order_text"),
            (F.col("orders") * 20).alias("views"),
            (F.col("orders") * 5).alias("visitors"),
            format_percent_bp(F.expr("(cancelled_orders * 10000) div orders")).alias("conversion_rate_text"),
            F.col("cancelled_orders"),
            (F.col("cancelled_cents") / 100.0).alias("cancelled_sales"),
            F.col("returned_orders"),
            (F.col("returned_cents") / 100.0).alias("returned_sales"),
            F.col("buyers"),
            F.col("new_buyers"),
            F.col("current_buyers"),
            (F.col("orders") * 3 - F.col("new_buyers")).alias("potential_buyers"),
            format_percent_bp(F.expr("(returned_orders * 10000) div orders")).alias("repeat_rate_text"),
        )

    # --- stock status: one row per (product, month) -----------------------
    def stock_status(self, without_month: int | None = None) -> DataFrame:
        """Every month; without one month of the year where rows shall lack a match."""
        from retailcast.operators.clean import prepare_sales
        from retailcast.operators.rollup import monthly_product_sales

        monthly = monthly_product_sales(prepare_sales(self.sales()))
        ids = (self.table("part")
               .select(product_key(F.col("p_brand"),
                                   F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string"))
                                   .otherwise(F.col("p_type"))).alias("product_key"),
                       "p_partkey")
               .groupBy("product_key").agg(F.min("p_partkey").alias("product_id")))
        q = F.col("qty")
        m = F.month("month")
        L = F.length("product_key")
        opening = (F.when((m + L) % 5 == 0, q)
                   .otherwise(F.greatest(F.lit(1).cast("long"),
                                         q + (((F.year("month") * 12 + m + L) % 9) - 2) * 8)))
        if without_month:
            monthly = monthly.where(F.month("month") != without_month)
        st = (monthly.join(ids, "product_key", "left")
              .select("product_id", "month", "product_key", q.alias("sold_qty"),
                      opening.cast("long").alias("opening_stock")))
        closing = F.greatest(F.col("opening_stock") - F.col("sold_qty"), F.lit(0).cast("long"))
        pending = F.greatest(F.col("sold_qty") - F.col("opening_stock"), F.lit(0).cast("long"))
        st = st.select("product_id", F.date_format("month", "yyyy-MM").alias("month_text"),
                       "product_key", "opening_stock", "sold_qty",
                       closing.alias("closing_stock"), pending.alias("pending"))
        status = (F.when(F.col("pending") > 0, F.lit("Understock"))
                  .when(F.col("closing_stock") == 0, F.lit("Optimal"))
                  .when(F.col("closing_stock") <= 20, F.lit("Kurang Optimal"))
                  .otherwise(F.lit("Overstock")))
        return st.withColumn("stock_status", status)

    # --- shop stock: one row per part -----------------------------------
    def shop_stock(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_code"),
            F.col("p_brand").alias("product"),
            F.col("p_partkey").cast("string").alias("variant_code"),
            F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string"))
             .otherwise(F.col("p_type")).alias("variant"),
            F.col("p_retailprice").alias("price"),
            F.col("p_size").alias("stock"))

    # --- holidays: fixed days of 1995-2001, date as M/d/yyyy text --------
    def holidays(self) -> DataFrame:
        days = F.array(*[F.struct(F.lit(mo).alias("mo"), F.lit(d).alias("d"), F.lit(n).alias("name"))
                         for mo, d, n in HOLIDAY_DAYS])
        lo, hi = HOLIDAY_YEARS
        base = (self.spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("year"))
                .select("year", F.explode(days).alias("h")))
        return base.select(
            F.concat_ws("/", F.col("h.mo").cast("string"), F.col("h.d").cast("string"),
                        F.col("year").cast("string")).alias("date_text"),
            F.col("h.name").alias("holiday_name"),
            F.col("year"))


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)


__all__ = ["Fixtures", "fixtures", "NO_VARIANT_LABEL", "TRAFFIC_START"]
