"""Mixing sources to target weights, in DataFrame functions only.

1. Sizes are summed by source. The mix's words are shared by weight; a source
   whose share passes ``max_epochs`` times its size stops there and the excess
   goes to the others by weight, until none is above. Each round is one
   aggregate over the sources; the stopped ones only grow in number.
2. A source's target is some complete epochs (every document so often) and a
   fraction of one. For the fraction its documents are put in the order of
   Efraimidis-Spirakis keys, ``-ln(u) / quality`` ascending, and taken from the
   start until their sizes add up to the rest of the target; a document at
   that end is taken if more than half of it lies before it. So a source's
   words differ from its target by at most half of one document.

``u`` is made of the document id's checksum, so reruns agree. A source may hold
most rows: rows are range-partitioned by (source, key), sums of the stretches
that ranges make of sources give each stretch its start, and only the one
stretch of a source in which the target ends is summed row by row. No source
is sorted or summed in one task.

Defined cases: a NULL size is 0 (as is the size of a NULL text), NULL is a
source of its own (the last), a NULL or NaN quality counts as 1, one of 0 or
less comes after all others. A source of size 0 has target 0. Rows that repeat an id have equal keys and
are taken in the order of size and quality; rows that agree in these too are
alike, so any of them may be the one taken. An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailcast.llm.common import cut_lineage, quoted
from retailcast.operators.allocate import rank_in_group


def word_count(text: Column) -> Column:
    """Number of words between white space of ASCII; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponential_key(doc_id: Column, quality: Column) -> Column:
    """``-ln(u) / quality``, u in (0, 1) from the id's checksum; NULL (after all) where quality is not above 0."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    weight = F.when(quality.isNull() | F.isnan(quality), F.lit(1.0)).otherwise(quality)
    return F.when(weight > 0, -F.log(u) / weight)


def source_name(source: Column) -> Column:
    """A name that is never NULL and keeps the order by code point, NULL last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def cyclic_weights(sources: DataFrame, weights: list[int]) -> DataFrame:
    """``sources`` with ``weight``: the given weights repeated over the sources in the order of ``name``."""
    ranked = rank_in_group(sources.withColumn("__all", F.lit(0)), "__all", [F.col("name")], "__n")
    at = (F.col("__n") % len(weights) + 1).cast("int")
    return ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), at)).drop("__all", "__n")


def with_targets(sources: DataFrame, share: tuple[int, int], max_epochs: int) -> DataFrame:
    """``sources`` (name, source_size, weight) with ``target``; ``share`` is the mix's size as a fraction of all sizes.

    ``level`` is the number of words for a weight of 1. It rises from round to
    round, so what has stopped stays so; sums are whole numbers.
    """
    cap = F.lit(max_epochs) * F.col("source_size")
    level, stopped = None, -1
    while True:
        full = F.lit(False) if level is None else cap.cast("double") <= F.col("weight") * F.lit(level)
        row = sources.agg(F.sum("source_size").alias("size"), F.sum(F.when(full, cap)).alias("held"),
                          F.sum(F.when(~full, F.col("weight"))).alias("weights"),
                          F.count(F.when(full, 1)).alias("stopped")).first()
        if row["stopped"] == stopped:
            break
        stopped = row["stopped"]
        if not row["weights"]:
            level = float("inf")   # every source has stopped
            break
        level = (share[0] * row["size"] - share[1] * (row["held"] or 0)) / (share[1] * row["weights"])
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def mix_sources(docs: DataFrame, weights: list[int], share: tuple[int, int] = (3, 2), max_epochs: int = 2,
                doc_id: str = "doc_id", size: str = "size", source: str = "source",
                quality: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, weight, target, epochs (how often taken), taken (words) per row."""
    quality_ = quoted(quality).cast("double") if quality else F.lit(1.0)
    # frozen once; the row number lets rows of one id spread over ranges
    rows = cut_lineage(docs.select(
        quoted(doc_id).alias("doc_id"), quoted(source).cast("string").alias("source"),
        F.coalesce(quoted(size), F.lit(0)).cast("long").alias("size"), quality_.alias("__q"),
        source_name(quoted(source)).alias("name"), exponential_key(quoted(doc_id), quality_).alias("__key"),
        F.monotonically_increasing_id().alias("__row")))
    sizes = cut_lineage(rows.groupBy("name").agg(F.sum("size").alias("source_size")))
    sources = with_targets(cut_lineage(cyclic_weights(sizes, weights)), share, max_epochs)

    order = [F.col("__key").asc_nulls_last(), *map(F.col, ("doc_id", "size", "__q", "__row"))]
    ranged = cut_lineage(rows.repartitionByRange("name", *order).withColumn("__part", F.spark_partition_id()))
    stretches = ranged.groupBy("name", "__part").agg(F.sum("size").alias("__words"))
    earlier = Window.partitionBy("name").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    starts = (stretches.withColumn("__start", F.coalesce(F.sum("__words").over(earlier), F.lit(0)))
              .join(sources, "name").withColumn("__epochs", epochs.cast("long"))
              .withColumn("__rest", F.col("target") - F.col("__epochs") * F.col("source_size"))
              .withColumn("__all", F.when(F.col("__start") >= F.col("__rest"), 0)
                          .when(F.col("__start") + F.col("__words") <= F.col("__rest"), 1)))
    placed = ranged.join(cut_lineage(starts), ["name", "__part"])
    inside = Window.partitionBy("name", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    settled = placed.where("__all IS NOT NULL").withColumn("__extra", F.col("__all"))
    opened = (placed.where("__all IS NULL").withColumn("__end", F.col("__start") + F.sum("size").over(inside))
              .withColumn("__extra", (F.col("__end") - F.col("size") / 2 <= F.col("__rest")).cast("int")).drop("__end"))
    done = settled.unionByName(opened).withColumn("epochs", (F.col("__epochs") + F.col("__extra")).cast("long"))
    return done.select("doc_id", "source", "size", "source_size", "weight", "target", "epochs",
                       (F.col("size") * F.col("epochs")).alias("taken"))
