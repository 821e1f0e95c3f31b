"""The row mapper: names that clash, NULLs, and workers that do not have the package installed."""

import os
import subprocess
import sys

from pyspark.sql import types as T

from helpers import odd_documents
from retailcast.llm.common import map_rows

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_carried_columns_and_clashing_names(spark):
    docs = odd_documents(spark)
    out = map_rows(docs, ["text"], lambda: lambda t: (len(t or ""), None), [("row", T.LongType()), ("res", T.StringType())],
                   docs.columns)
    assert out.select("row.*").columns == docs.columns
    assert sorted(str(r) for r in out.select("row.*").collect()) == sorted(str(r) for r in docs.collect())
    assert {r.row for r in out.select("res.row").collect()} == {len(r.text or "") for r in docs.collect()}


def test_workers_receive_the_package(tmp_path):
    """A driver that found the package by sys.path alone, in another folder than the repository's."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "1").getOrCreate())
from retailcast.llm import secret_scan
df = spark.createDataFrame([(1, "password=abcdefabcdefabcdef12")], "doc_id long, text string")
print("found", secret_scan.scan_secrets(df).select("res.spans").first()[0][0].kind)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "found assign" in done.stdout, done.stderr[-2000:]
