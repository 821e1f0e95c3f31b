"""CSV / parquet sources.

CSV is read with an explicit schema when one is given (no inference pass
over the data), permissive mode (bad fields -> NULL) and quoting on, so
product names with commas survive. A ``row_order`` column can be attached: a struct
that sorts rows by file name and place in the file, which is what 'keep the
first row' rules need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from retailcast.functions.calendar import month_from_text


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, *,
             encoding: str = "UTF-8", sep: str = ",", with_row_order: bool = False, multi_line: bool = False,
             corrupt_column: str | None = None) -> DataFrame:
    """Header CSV, typed by ``schema`` (all strings when None).

    ``multi_line`` keeps quoted line breaks inside a record (a file is then
    read by one task, so leave it off where no field holds one).
    ``corrupt_column`` receives the raw text of records that do not fit."""
    r = (spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
         .option("multiLine", multi_line).option("mode", "PERMISSIVE").option("encoding", encoding))
    if schema is not None:
        kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if corrupt_column:
            kind = StructType([*kind.fields, StructField(corrupt_column, StringType())])
            r = r.option("columnNameOfCorruptRecord", corrupt_column)
        r = r.schema(kind)
    df = r.csv(path)
    if with_row_order:
        # Spark deals file blocks by size, so a row's place is its file, its block and its number therein
        df = df.withColumn("row_order", F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row")))
    return df


def read_csv_with_fallback(spark: SparkSession, path: str, schema: StructType | str | None = None, *,
                           fallback: str = "ISO-8859-1", with_row_order: bool = False) -> DataFrame:
    """UTF-8 where a file's bytes are UTF-8, else ``fallback``, file by file. The files of ``path``
    share one header; ``folders.read_csv_folder`` reads files that do not."""
    from retailcast.sources.folders import escaped, file_encodings

    by_encoding: dict[str, list[str]] = {}
    for file, encoding in sorted(file_encodings(spark, path, fallback).items()):
        by_encoding.setdefault(encoding, []).append(escaped(file))
    if len(by_encoding) < 2:
        return read_csv(spark, path, schema, encoding=next(iter(by_encoding), "UTF-8"), with_row_order=with_row_order)
    kind = schema or read_csv(spark, path).schema   # one header for all, so one list of columns
    first, *rest = [read_csv(spark, files, kind, encoding=e, with_row_order=with_row_order)
                    for e, files in by_encoding.items()]
    return reduce(DataFrame.unionByName, rest, first)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", month_col: str | None = None) -> DataFrame:
    """S3: re-read a written table; a 'yyyy-MM' month text can be turned back
    into a DATE column ``month_date``."""
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True).option("escape", '"')
    df = r.load(path)
    if month_col:
        df = df.withColumn("month_date", month_from_text(F.col(month_col)))
    return df
