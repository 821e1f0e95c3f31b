"""A corpus pipeline of five stages over the ``documents`` table.

1. ``language_id`` keeps documents that have a main language; the model is
   learned from the stage's own labelled rows.
2. ``simhash_near_dedup`` keeps one document of each near-duplicate group.
3. ``benchmark_decontamination`` removes documents that hold ten words in a
   row of a benchmark item (an item of fewer words has no such run and removes
   nothing).
4. ``secret_scan`` keeps all documents and replaces secrets in their texts.
5. ``byte_bpe`` encodes the texts: the documents' columns, with the text
   decoded back from the ids, and the ids and their number.

Each stage takes (spark, docs, sf_dir); all but the last return the columns
of ``docs``. NULL and empty texts are rejected by the first stage; an empty
table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.llm import bpe_codec, decontaminate, language_id, secret_scan, simhash
from retailcast.llm.common import scratch_path, table
from retailcast.sources.sinks import remove


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_component(docs, shingle=4, radius=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), n=10, min_words=10)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = bpe_codec.encode_documents(docs, carry=[c for c in docs.columns if c != "text"], decoded=True)
    columns = [F.decode("res.decoded", "UTF-8").alias(c) if c == "text" else F.col("row")[c].alias(c)
               for c in docs.columns]
    return done.select(*columns, F.col("res.ids").alias("token_ids"),
                       F.size("res.ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", identify_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]

#: The stages' methods have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again.

    A stage's folder goes when the next one is written; the result reads the last one.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
