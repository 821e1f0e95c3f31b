"""Shared pieces of the operators: one-pass mappers and small helpers.

Rules that hold for every operator built on :func:`map_batches`:

* the input may hold any further columns, under any names: results travel in
  a struct of their own (``res``) beside the carried input columns (``row``),
  so names never clash;
* a NULL text is an empty text; an empty table gives an empty result;
* repeated rows are separate rows and give separate, equal results.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from retailcast.session import (checkpoint_root, cut_lineage, map_in_arrow, scratch_path,  # noqa: F401 - used by the
                                ship_code)                                          # operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: str) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower()


def map_batches(df: DataFrame, inputs: Sequence[str], make: Callable[[], Callable],
                fields: Sequence[tuple[str, T.DataType]], carry: Sequence[str]) -> DataFrame:
    """Apply a Python function to each Arrow batch in one narrow pass.

    ``make()`` runs once per task and returns a function from the Arrow arrays
    of ``inputs`` to one Arrow array per field, of the same length. The result
    has two struct columns: ``row`` holds the ``carry`` columns of the input
    and ``res`` the fields. No shuffle; memory is one Arrow batch (Spark
    bounds it by rows and bytes).
    """
    need = list(dict.fromkeys([*carry, *inputs]))
    src = df.select(F.struct(*[quoted(c) for c in need]).alias("row"))
    by_name = {f.name: f for f in src.schema["row"].dataType.fields}
    res = T.StructType([T.StructField(n, t) for n, t in fields])
    out = T.StructType([T.StructField("row", T.StructType([by_name[c] for c in carry])),
                        T.StructField("res", res)])
    types = [to_arrow_type(t) for _, t in fields]
    names = [n for n, _ in fields]
    carry, inputs = list(carry), list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            row = batch.column(0)
            if not len(row):
                continue
            cols = [c.cast(t) for c, t in zip(f(*(row.field(c) for c in inputs)), types)]
            kept = pa.StructArray.from_arrays([row.field(c) for c in carry], carry)
            yield pa.RecordBatch.from_arrays([kept, pa.StructArray.from_arrays(cols, names)], ["row", "res"])

    return map_in_arrow(src, run, out)


def map_rows(df: DataFrame, inputs: Sequence[str], make: Callable[[], Callable],
             fields: Sequence[tuple[str, T.DataType]], carry: Sequence[str]) -> DataFrame:
    """:func:`map_batches` for a function of one row: ``f(*inputs) -> tuple``, one value per field."""
    types = [to_arrow_type(t) for _, t in fields]

    def make_batch():
        f = make()

        def apply(*arrays):
            values = [f(*(v.as_py() for v in vs)) for vs in zip(*arrays)]
            return [pa.array([v[i] for v in values], t) for i, t in enumerate(types)]

        return apply

    return map_batches(df, inputs, make_batch, fields, carry)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file's bytes, read once by the driver.

    Tokenizer vocabularies are a few MB whatever the corpus size, so the bytes
    may travel to the tasks as a broadcast variable; the executors then need
    no copy of the file.
    """
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def vocabulary_path(name: str) -> str:
    """The installed place of a public vocabulary file (a default; every operator takes a path)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def rank_pattern() -> str:
    """The published pattern that splits text before the merges of the rank files."""
    import public_tokenizers
    return public_tokenizers.PATTERN
