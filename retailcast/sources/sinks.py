"""Sinks (K1-K4): feature table, comparison report, model, forecast export.

Writes are distributed (one file per task). ``sort_by`` orders the whole
output by range partitions, so files and the rows in them follow the order;
``sort_within`` only orders the rows of each file.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COUNTED = ("parquet", "orc")   # formats that know their rows without being parsed


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                sort_within: list[str] | None = None, sort_by: list[str] | None = None) -> int:
    """K1, O1: replace ``path``, return the rows written; CSV gets a header and no index column.

    The table is written beside ``path`` first, its rows are counted on the
    way (and again from the files where they know them), and only then it
    takes the old one's place: a write that fails leaves the old table as it
    was, readable all the while.
    """
    out = df.sortWithinPartitions(*sort_within) if sort_within else df
    out = out.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else out
    seen = Observation()
    w = out.observe(seen, F.count(F.lit(1)).alias("rows")).write
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = (w.option("header", True).option("escape", '"')
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))   # text stays as it is
    spark, place = df.sparkSession, path.rstrip("/")
    staged = f"{place}.staged-{uuid.uuid4().hex}"
    try:
        w.format(fmt).save(staged)
        rows = seen.get["rows"]
        if fmt in COUNTED and (found := spark.read.format(fmt).load(staged).count()) != rows:
            raise OSError(f"{found} of {rows} rows were written to {staged}")
    except Exception:
        remove(spark, staged)
        raise
    swap(spark, staged, place)
    return rows


def _hadoop(spark: SparkSession, path: str):
    """The file system of ``path`` and the path in it, as Spark's own writers see them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """``staged`` takes the place of ``path``; if it cannot, the old folder goes back."""
    fs, new = _hadoop(spark, staged)
    _, place = _hadoop(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    had = fs.exists(place)
    if had and not fs.rename(place, old):
        raise OSError(f"{path} could not be moved")
    if not fs.rename(new, place):
        if had:
            fs.rename(old, place)
        raise OSError(f"{staged} could not take the place of {path}")
    if had:
        fs.delete(old, True)


def write_report(*frames: DataFrame, path: str) -> None:
    """K2: comparison results (verdict, shape, values, nulls) as JSON lines,
    one folder per frame under ``path``."""
    for i, f in enumerate(frames):
        write_table(f, f"{path}/part_{i}", fmt="json")


def save_model(model: PipelineModel, path: str) -> None:
    """K3: MLlib persistence (stages and the feature order travel together)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def export_forecasts(forecast: DataFrame, folder: str, now: _dt.datetime | None = None) -> str:
    """K4: forecasts as CSV under a time-stamped name; returns the path."""
    stamp = (now or _dt.datetime.now()).strftime("%Y%m%d_%H%M%S")
    path = f"{folder}/forecast_{stamp}"
    write_table(forecast, path, fmt="csv", sort_within=[c for c in ("product_key", "month") if c in forecast.columns])
    return path
