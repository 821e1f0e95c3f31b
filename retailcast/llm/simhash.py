"""SimHash near-duplicates: fingerprints, exact comparison in tiles, components.

Fingerprint: words (runs without ASCII white space, A-Z lower-cased) make
shingles, repeats included; a bit is set if it is set in over half of the
shingles' XXH64 values (seed 42).

Links are all pairs of fingerprints that differ in at most ``radius`` bits,
found exactly:

* equal fingerprints are one node, so exact copies cost nothing;
* the 64 bits are cut into blocks; two fingerprints within the radius agree in
  all blocks but ``radius`` of them, so comparing only inside buckets of
  agreeing blocks loses no pair. The number of blocks follows the number of
  distinct fingerprints, which keeps buckets near one tile at every size;
* a bucket is a tile of at most about ``tile`` fingerprints; larger buckets
  are cut into tiles by population count and hash, and tile pairs whose
  population counts differ by more than the radius are never joined;
* inside a tile (or tile pair) numpy compares sub-tiles by exclusive-or and
  bit count, again skipping sub-tiles by population count. What leaves it is
  one star per linked group and not the pairs, so a large group of near copies
  gives as many rows as it has members.

Components come from alternating large-star / small-star steps over those
edges, each step checkpointed in the shared folder.

Defined cases: a text without words (NULL, empty, white space) has fingerprint
zero and links like any other; fewer words than the shingle length give one
shingle of all words; the component id is the smallest non-NULL document id,
NULL if a component has no id; repeated rows and ids stay separate rows; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast.llm.common import ascii_lower, cut_lineage, map_in_arrow, map_rows, quoted

SEED = 42
SUB_TILE = 256
CHUNK = 1 << 16   # shingles hashed at once, so that a very long text needs no more memory


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = ascii_lower(text).split() if text else []   # bytes.split(): exactly ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    first, last = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        cut = [joined[a:b] for a, b in zip(first[at:at + CHUNK], last[at:at + CHUNK])]
        h = np.fromiter(map(xxh64_intdigest, cut, repeat(SEED)), "<u8", len(cut))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def bit_masks(distinct: int, radius: int, tile: int) -> list[int]:
    """Masks of agreeing bits: any two values within the radius agree under at least one of them."""
    blocks = radius + 1
    while distinct > tile << (64 * (blocks - radius) // blocks) and blocks < radius + 8:
        blocks += 1
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(block, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_stars(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges (root, member) that connect what is linked in tile ``a``, or between tiles ``a`` and ``b``."""
    n = len(a)
    values = a if b is None else np.concatenate([a, b])
    label = np.arange(len(values))
    pops = np.bitwise_count(values)
    left = np.argsort(pops[:n], kind="stable")
    right = left if b is None else n + np.argsort(pops[n:], kind="stable")
    linked = False
    for i in range(0, len(left), SUB_TILE):
        x = left[i:i + SUB_TILE]
        for j in range(i if b is None else 0, len(right), SUB_TILE):
            y = right[j:j + SUB_TILE]
            if int(pops[y[0]]) - int(pops[x[-1]]) > radius:
                break   # sorted by population count: all later ones differ more
            if int(pops[x[0]]) - int(pops[y[-1]]) > radius:
                continue
            near = np.bitwise_count(values[x][:, None] ^ values[y][None, :]) <= radius
            p, q = np.nonzero(near)
            p, q = x[p], y[q]
            p, q = p[p != q], q[p != q]
            linked = linked or len(p) > 0
            while len(p):
                apart = label[p] != label[q]
                p, q = p[apart], q[apart]
                # hook the larger root of each pair below the smaller, then flatten the labels
                np.minimum.at(label, np.maximum(label[p], label[q]), np.minimum(label[p], label[q]))
                while True:
                    flat = label[label]
                    if np.array_equal(flat, label):
                        break
                    label = flat
    if not linked:
        return []
    member = np.nonzero(label != np.arange(len(label)))[0]
    return list(zip(values[label[member]].view(np.int64).tolist(), values[member].view(np.int64).tolist()))


def fingerprint_links(prints: DataFrame, radius: int, tile: int = 4096) -> DataFrame:
    """Edges (u, v) over distinct values ``fp`` that connect all values within the radius."""
    distinct = prints.count()
    masks = bit_masks(distinct, radius, tile)
    bucketed = prints.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value"))
        for i, m in enumerate(masks)])).alias("k")).select("fp", "pop", "k.mask", "k.value")
    big = (bucketed.groupBy("mask", "value").agg(F.count("*").alias("members"))
           .where(F.col("members") > tile))
    # a bucket over the tile size is cut by population count and hash; all others are one tile
    parts = F.ceil(F.col("members") / F.lit(tile))
    tiles = cut_lineage(
        bucketed.join(big, ["mask", "value"], "left")
        .groupBy("mask", "value", F.col("members").isNotNull().alias("cut"),
                 F.when(F.col("members").isNotNull(), F.col("pop")).alias("pop"),
                 F.when(F.col("members").isNotNull(), F.pmod(F.xxhash64("fp"), parts)).alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.col("cut") | (F.size("fps") > 1)))
    cut = tiles.where("cut").drop("cut")
    other = cut.select("mask", "value", F.col("pop").alias("pop2"), F.col("part").alias("part2"),
                       F.col("fps").alias("fps2"))
    pairs = (cut.join(other, ["mask", "value"])
             .where((F.col("pop2") - F.col("pop")).between(0, radius))
             .where((F.col("pop2") > F.col("pop")) | (F.col("part2") > F.col("part"))))
    work = tiles.select("fps", F.lit(None).cast("array<bigint>").alias("fps2")).unionByName(
        pairs.select("fps", "fps2"))

    def compare(batches):
        for batch in batches:
            edges = []
            for a, b in zip(batch.column(0), batch.column(1)):
                x = a.values.to_numpy().view(np.uint64)
                y = b.values.to_numpy().view(np.uint64) if b.is_valid else None
                edges += link_stars(x, y, radius)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()),
                                              pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])

    return map_in_arrow(work, compare, "u bigint, v bigint").distinct()


def components(edges: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges (u, v); the root is the component's smallest node.

    Alternating large-star and small-star steps: each joins edges with one
    minimum per node, so a node with many neighbours is a partial aggregate
    and a join that can be split, never a group held in one task.

    With ``rows_per_task``, what a step makes of its counted edges stays in
    tasks of about so many rows, so few edges leave few shuffle files whatever
    the session's number of partitions.
    """
    def few(df: DataFrame) -> DataFrame:
        return df.coalesce(max(1, -(-2 * rows // rows_per_task))) if rows_per_task else df

    current, before = cut_lineage(edges.where("u <> v")), None
    rows = current.count() if rows_per_task else 0
    while True:
        current = few(current)
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = few(both.join(low, "u").where(F.col("v") > F.col("u"))
                    .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        down = few(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = few(down.join(least, "u")).select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        current = cut_lineage(few(small.where("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, rows = state, state[0]


def fingerprints(docs: DataFrame, text: str, shingle: int, carry: list[str]) -> DataFrame:
    """Columns ``row`` (the carried columns) and ``res.fp``, the signed 64-bit fingerprint."""
    def make():
        return lambda t: (signed(fingerprint(t, shingle)),)

    return map_rows(docs, [text], make, [("fp", T.LongType())], carry)


def rooted_components(docs: DataFrame, doc_id: str, text: str, shingle: int = 4, radius: int = 4,
                      tile: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id, root (the component's own fingerprint)."""
    prints = cut_lineage(fingerprints(docs, text, shingle, [doc_id]).select(
        F.col("row")[doc_id].alias("doc_id"), F.col("res.fp").alias("fp")))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    member = components(fingerprint_links(nodes.select("fp"), radius, tile)).select(
        F.col("node").alias("fp"), "root")
    named = nodes.join(member, "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(lowest, "root").select("fp", "component_id", "root")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id", "root")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
                       radius: int = 4, tile: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed 64-bit fingerprint), component_id."""
    return rooted_components(docs, doc_id, text, shingle, radius, tile).drop("root")


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, with exactly its columns.

    The row with the smallest document id stays; where a component has that
    id more than once, the smallest of these rows. An id may be on rows of
    several components. Rows without an id cannot be addressed and stay.
    """
    shingle = options.get("shingle", 4)
    found = cut_lineage(rooted_components(docs, doc_id, text, **options))
    first = F.col("doc_id") == F.col("component_id")
    ids = cut_lineage(found.groupBy("doc_id").agg(F.count("*").alias("copies"), F.max(first).alias("first"))
                      .where("first"))
    raw = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("text"),
                      F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    single, repeated = ids.where("copies = 1"), ids.where("copies > 1")
    kept = raw.join(single, raw["id"] == single["doc_id"], "left_semi").select("row.*")
    if not repeated.isEmpty():   # else the texts need not be shuffled a second time
        # the id does not say which of its rows are meant: their fingerprints do
        roots = found.where(first).join(repeated, "doc_id", "left_semi").select("doc_id", "fp", "root").distinct()
        rows = fingerprints(raw.join(repeated, raw["id"] == repeated["doc_id"], "left_semi"), "text", shingle,
                            ["id", "row"]).select(F.col("row.id").alias("doc_id"), F.col("res.fp").alias("fp"),
                                                  F.col("row.row").alias("row"))
        kept = kept.unionByName(rows.join(roots, ["doc_id", "fp"]).groupBy("root").agg(F.min("row").alias("row"))
                                .select("row.*"))
    return kept.unionByName(raw.where("id is null").select("row.*"))
