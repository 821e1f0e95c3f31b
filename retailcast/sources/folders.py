"""Folders of CSV files that were not written together.

Monthly exports differ: columns move, come and go, and some files are Latin-1.
Spark's reader takes the first file's header for a whole folder and one
encoding for all files, so a folder is read in groups of files that agree:

* encoding: one pass over the lines, a boolean aggregate by file (a file with a
  line that is not UTF-8 is Latin-1);
* header: read per file by Spark's own CSV reader (one small job per file that
  reads its first block's first line);
* each group is read with its own header and resolved by its own names, and the
  groups are united by name.

A folder has as many groups as distinct (encoding, header) pairs. Files without
a line are left out; a column that no file has is NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.sources.readers import read_csv
from retailcast.sources.schema import resolve_columns

UTF8, LATIN1 = "UTF-8", "ISO-8859-1"
HEADER_THREADS = 16   # headers asked for at the same time


@dataclass
class FileGroup:
    """Files with one encoding and one header."""

    encoding: str
    header: tuple[str, ...]
    files: list[str] = field(default_factory=list)


def file_encodings(spark: SparkSession, path: str | list[str], fallback: str = LATIN1) -> dict[str, str]:
    """{file: encoding} of all files with at least one line.

    The result has one row per file, as the listing of the folder has.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"),
                                         F.is_valid_utf8("value").alias("ok"))
    rows = lines.groupBy("file").agg(F.bool_and("ok").alias("ok")).collect()
    return {unquote(r["file"]): UTF8 if r["ok"] else fallback for r in rows}


def file_groups(spark: SparkSession, path: str | list[str], fallback: str = LATIN1, **options) -> list[FileGroup]:
    """Groups of files that can be read together, in the order of their first files."""
    encodings = file_encodings(spark, path, fallback)

    def header(file: str) -> tuple[str, ...]:
        return tuple(read_csv(spark, escaped(file), encoding=encodings[file], **options).columns)

    files = sorted(encodings)
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        headers = list(pool.map(header, files))
    groups: dict[tuple, FileGroup] = {}
    for file, names in zip(files, headers):
        key = (encodings[file], names)
        groups.setdefault(key, FileGroup(*key)).files.append(file)
    return list(groups.values())


def escaped(file: str) -> str:
    """A file name that the reader does not take for a pattern."""
    return "".join("\\" + c if c in "[]{}*?\\" else c for c in file)


def read_group(spark: SparkSession, group: FileGroup, *, with_row_order: bool = False, **options) -> DataFrame:
    """All columns as text, under the group's own header."""
    schema = ", ".join("`" + c.replace("`", "``") + "` STRING" for c in group.header)
    return read_csv(spark, [escaped(f) for f in group.files], schema, encoding=group.encoding,
                    with_row_order=with_row_order, **options)


def read_csv_folder(spark: SparkSession, path: str | list[str],
                    resolve: Callable[[DataFrame], DataFrame] = lambda df: df, *,
                    with_row_order: bool = False, fallback: str = LATIN1, **options) -> DataFrame:
    """All files of a folder, each group passed through ``resolve``, united by column name.

    A column that only some files have is NULL in the others. ``row_order``
    sorts rows by file and place in it, over all groups.
    """
    parts = [resolve(read_group(spark, g, with_row_order=with_row_order, **options))
             for g in file_groups(spark, path, fallback, **options)]
    if not parts:   # no file has a line
        empty = spark.createDataFrame([], "row_order struct<file:string,block:bigint,row:bigint>")
        return resolve(empty if with_row_order else empty.drop("row_order"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def resolved(df: DataFrame, names: dict[str, str | None], kinds: Iterable[tuple[str, str]]) -> DataFrame:
    """The logical fields ``kinds`` (name, type) of one group of files, typed; absent ones are NULL."""
    return df.select(*[(F.col("`" + names[f].replace("`", "``") + "`").try_cast(kind) if names.get(f)
                        else F.lit(None).cast(kind)).alias(f) for f, kind in kinds])


def read_role_folder(spark: SparkSession, path: str | list[str], role: str, kinds: dict[str, str],
                     **options) -> DataFrame:
    """H1 file by file: the logical fields of ``role`` (see ``schema.COLUMN_ALIASES``), typed by ``kinds``.

    Each group of files finds its own column for a field, so one file may call
    the date 'Tanggal' and the next 'Date'.
    """
    return read_csv_folder(spark, path, lambda part: resolved(part, resolve_columns(part, role), kinds.items()),
                           **options)
