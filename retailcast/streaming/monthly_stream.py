"""Monthly product sales (A1) over a stream of order lines.

The same roll-up as ``monthly_product_sales``, kept up to date as order-line
files arrive, in any order of their payment times. There is no watermark: a
late line updates its month like any other. The state is one running total per
(month, product), as large as the roll-up itself. Each micro-batch's changed
rows are handed to a batch function (for example a MERGE into the feature
table's input); a checkpoint location in the shared folder makes the query
restartable after executor or driver loss.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from retailcast.operators.clean import prepare_sales
from retailcast.operators.rollup import count_sum, money_sum

KEY = ["month", "product_key"]


def monthly_sales_stream(lines: DataFrame) -> DataFrame:
    """Running (month, product) quantity and exact net amount (``net``, unscaled)."""
    s = prepare_sales(lines)
    return (s.where(F.col("product_key").isNotNull() & F.col("month").isNotNull())
             .groupBy(*KEY).agg(count_sum("qty").alias("qty"), money_sum("net_price").alias("net")))


def start_monthly_sales_stream(spark: SparkSession, source_dir: str, schema: StructType | str,
                               on_batch: Callable[[DataFrame, int], None], checkpoint: str,
                               fmt: str = "parquet", available_now: bool = False) -> StreamingQuery:
    """Read order-line files from ``source_dir`` and call ``on_batch`` with
    each micro-batch's updated rows (``update`` output mode: the running
    totals of the (month, product) keys that changed, to be upserted)."""
    lines = spark.readStream.schema(schema).format(fmt).load(source_dir)
    w = (monthly_sales_stream(lines).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(on_batch))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def finish_monthly(totals: DataFrame, scale: int = 1000, batch_col: str = "batch_id") -> DataFrame:
    """Upserted totals in the batch roll-up's shape. If the sink appended
    batches instead of upserting, the latest batch per key wins."""
    if batch_col in totals.columns:
        latest = totals.groupBy(*KEY).agg(F.max_by(F.struct("qty", "net"), F.col(batch_col)).alias("v"))
        totals = latest.select(*KEY, "v.qty", "v.net")
    amount = (F.col("net") * F.lit(scale)).cast("long")
    return totals.select(*KEY, "qty", amount.alias("net_amount"), amount.alias("sales_amount"))
