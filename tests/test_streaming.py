"""The streaming monthly roll-up, merged, equals the batch roll-up."""

from pyspark.sql import functions as F

from retailcast.operators.clean import prepare_sales
from retailcast.operators.rollup import monthly_product_sales
from retailcast.sources.fixtures import Fixtures
from retailcast.streaming.monthly_stream import finish_monthly, start_monthly_sales_stream


def test_stream_equals_batch(spark, tmp_path):
    sales = Fixtures(spark, "/root/testdata/sf0.001").sales()
    src = str(tmp_path / "lines")
    sales.write.parquet(src)
    out = str(tmp_path / "partials")

    def sink(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    q = start_monthly_sales_stream(spark, src, sales.schema, sink, str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(300)
    got = finish_monthly(spark.read.parquet(out))
    want = monthly_product_sales(prepare_sales(sales))
    cols = ["month", "product_key", "qty", "net_amount", "sales_amount"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_late_files_count(spark, tmp_path):
    """Files from 1998 on first, older ones second, with one checkpoint: nothing is lost."""
    sales = Fixtures(spark, "/root/testdata/sf0.001").sales()
    src, out = str(tmp_path / "lines"), str(tmp_path / "totals")

    def sink(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    for number, part in enumerate((sales.where("year(paid_at) >= 1998"), sales.where("year(paid_at) < 1998"))):
        part.write.mode("append").parquet(src)
        start_monthly_sales_stream(spark, src, sales.schema, lambda b, i, n=number: sink(b, 1000 * n + i),
                                   str(tmp_path / "ckpt"), available_now=True).awaitTermination(300)
    got = finish_monthly(spark.read.parquet(out))
    want = monthly_product_sales(prepare_sales(sales))
    cols = ["month", "product_key", "qty", "net_amount", "sales_amount"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
