"""Equi-joins in which one key holds a large share of the rows.

Keys are hashed to one number each; a sketch (``approx_top_k``, one row, of
bounded size) of every side names the keys that may hold more than ``share`` of
its rows, and one count of just those keys makes the names exact. Rows of all
other keys are joined as usual. A key that is hot and present on both sides is
joined in a grid: its left rows are dealt to ``a`` pieces and its right rows to
``b``, and every left piece meets every right piece in a cell, one task, so each
pair is made exactly once and no task holds the key. A cell is bounded by its rows
and by the pairs it makes: a few rows against millions make many pairs too. Pieces
are stored once and read by each of their cells (a Cartesian product of
partitions), so what is stored grows with the rows and not with the cells. A
hot key that one side lacks needs no join at all.

A recomputation cannot deal a row anew: the smaller side is numbered before a
checkpoint, the other is dealt in turn after Spark's sort of each task's rows
(``spark.sql.execution.sortBeforeRepartition``, the default).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.session import cut_lineage

TRACKED = 4096    # keys that a sketch follows
NAMED = 128       # of them, how many it names
SHARE = 0.01      # of a side's rows
MOST_PIECES = 64  # of one side, by its rows
PAIRS = 1 << 24   # of a cell
MOST_CELLS = 4096   # of a key
LIST = 1 << 12    # rows of the smaller side that are gathered
RUN = 1 << 10     # of them, how many a row of the other side meets at once
FEW = 4           # hot keys of both sides that are each read from the inputs


@dataclass(frozen=True)
class HotKey:
    """A key with many rows; the join makes ``left * right`` rows of it."""

    hash: int
    key: tuple
    left: int
    right: int

    @property
    def pairs(self) -> int:
        return self.left * self.right


def key_hash(keys: list[str]) -> Column:
    """One number for a key, NULL parts included."""
    return F.xxhash64(*[F.struct(F.col(f"`{k}`").isNull(), F.col(f"`{k}`")) for k in keys])


def hot_keys(left: DataFrame, right: DataFrame, keys: list[str], share: float = SHARE) -> list[HotKey]:
    """Keys with at least ``share`` of the rows of a side, most pairs first; NULL is a key like any other.

    At most a hundred or so rows reach the driver. Callers can look at
    ``pairs`` before the join is built.
    """
    kinds = [[dict(d.dtypes)[k] for k in keys] for d in (left, right)]
    if kinds[0] != kinds[1]:   # equal values of two types have two hashes
        return []
    found: dict[int, list] = {}
    sizes = []
    for df in (left, right):
        row = df.select(key_hash(keys).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr(
            f"approx_top_k(h, {NAMED}, {TRACKED})").alias("top")).first()
        sizes.append(row["n"])
        for item in row["top"] or []:
            if item["count"] >= share * row["n"] > 0:
                found[item["item"]] = [None, 0, 0]
    if not found:
        return []
    shared = set()
    for side, df in enumerate((left, right)):
        rows = df.withColumn("__h", key_hash(keys)).where(F.col("__h").isin(list(found))).groupBy(
            "__h", *[F.col(f"`{k}`") for k in keys]).count().collect()
        for r in rows:
            key = tuple(r[i + 1] for i in range(len(keys)))
            own = found[r["__h"]]
            if own[0] not in (None, key):
                shared.add(r["__h"])   # two keys of one hash: both stay with the usual join
            own[0], own[1 + side] = key, r["count"]
    hot = [HotKey(h, k, n, m) for h, (k, n, m) in found.items() if h not in shared and k is not None
           and (n >= share * sizes[0] > 0 or m >= share * sizes[1] > 0)]
    return sorted(hot, key=lambda x: -x.pairs)


def pieces(hot: HotKey, rows: int, pairs: int = PAIRS) -> tuple[int, int]:
    """Numbers of left and right pieces such that a piece has about ``rows`` rows and a cell about ``pairs`` pairs.

    The side with the larger pieces is cut further: the rows of the other side are repeated for each piece.
    """
    sizes = (hot.left, hot.right)
    cut = [max(1, min(MOST_PIECES, math.ceil(n / rows))) for n in sizes]
    while cut[0] * cut[1] < min(MOST_CELLS, math.ceil(hot.pairs / pairs)):
        side = max((0, 1), key=lambda i: sizes[i] / cut[i])
        most = math.ceil(hot.pairs / pairs / cut[1 - side])
        even = math.ceil(sizes[side] * cut[1 - side] / max(1, sizes[1 - side]))   # pieces as large as the other side's
        cut[side] = max(cut[side] + 1, min(most, even, MOST_CELLS // cut[1 - side]))
    return tuple(cut)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, hot: list[HotKey],
               rows_per_piece: int = 1 << 20, pairs_per_cell: int = PAIRS) -> DataFrame:
    """Structs ``l`` and ``r`` of the matching rows, NULL where a side has none; ``how`` is left, right, outer or inner."""
    ls, rs = (d.select(F.struct("*").alias(name), key_hash(keys).alias("h")) for d, name in ((left, "l"), (right, "r")))
    names = [x.hash for x in hot]
    both = [x for x in hot if x.left and x.right]
    same = reduce(lambda x, y: x & y, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys])
    kind = "full_outer" if how == "outer" else how

    def cold(side):
        return side.where(~F.col("h").isin(names)) if names else side

    parts = [cold(ls).drop("h").join(cold(rs).drop("h"), same, kind).select("l", "r")]
    if len(both) > FEW:   # else each key reads its rows from the inputs
        hot_ls, hot_rs = (cut_lineage(side.where(F.col("h").isin([x.hash for x in both]))) for side in (ls, rs))
    else:
        hot_ls, hot_rs = ls, rs
    parts += [_grid(hot_ls, hot_rs, x, *pieces(x, rows_per_piece, pairs_per_cell)) for x in both]
    for side, name, other, keep in ((ls, "l", rs, ("left", "outer")), (rs, "r", ls, ("right", "outer"))):
        alone = [x.hash for x in hot if not (x.right if name == "l" else x.left)]
        if alone and how in keep:
            kind_of = other.schema["r" if name == "l" else "l"].dataType
            none = F.lit(None).cast(kind_of).alias("r" if name == "l" else "l")
            parts.append(side.where(F.col("h").isin(alone)).select(name, none).select("l", "r"))
    return reduce(DataFrame.unionByName, parts)


def _grid(ls: DataFrame, rs: DataFrame, hot: HotKey, a: int, b: int) -> DataFrame:
    """The pairs of a hot key that both sides have, in ``a * b`` tasks. Rows of one hash have one key, as ``hot_keys`` counted them.

    The rows of the smaller side are gathered in sorted runs, and a run meets the rows of the other side one by one. Most
    runs have ``RUN`` rows exactly: a Parquet page of the result (20,000 rows) then repeats the same bytes and shrinks.
    """
    ls, rs = (side.where(F.col("h") == hot.hash).select(name) for side, name in ((ls, "l"), (rs, "r")))
    few, run, n, many, name, m = (ls, "l", a, rs, "r", b) if hot.left < hot.right else (rs, "r", b, ls, "l", a)
    lists = max(n, math.ceil(min(hot.left, hot.right) / LIST))
    rows = F.collect_list(run)
    if not re.search(r"\b(map<|variant|interval)", few.schema[run].dataType.simpleString()):   # these have no order
        rows = F.sort_array(rows)
    gathered = few.withColumn("list", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lists))).repartitionByRange(
        n, "list").groupBy("list").agg(rows.alias("rows"))
    runs = cut_lineage(gathered.select(F.expr(
        f"explode(transform(sequence(1, size(rows), {RUN}), i -> slice(rows, i, {RUN})))").alias("run")))
    columns = many.schema[name].dataType.names   # one by one: a pair's columns are then read without the struct
    flat = many.select(*[F.col(f"{name}.`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).repartition(m)
    whole = F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]).alias(name)
    return runs.hint("shuffle_replicate_nl").crossJoin(flat).select(whole, F.explode("run").alias(run)).select("l", "r")
