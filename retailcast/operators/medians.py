"""Exact medians of columns and of groups without gathering a column or a group into one task.

``F.median`` keeps every distinct value of a global group in one buffer. This
selects the two middle order statistics by bucket refinement instead: each
pass counts the values of the still-open range per (column, bucket) with a
partial aggregate (map-side combine, so a value repeated a billion times is
one partial row per task), keeps the bucket that holds the wanted rank and
narrows the range to that bucket's min/max. The state carried between passes
is two small rows per column; it terminates when a range holds one value.

Semantics follow pandas: NULL (and NaN) are skipped; with
``count_infinite=True`` +-inf are ordinary values (sorted at the ends),
otherwise they are skipped too. Even counts average the two middle values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailcast.session import cut_lineage

# The per-pass aggregate holds at most min(BUCKETS, distinct values) rows
# per (column, target); a wide grid usually resolves the rank in one pass.
BUCKETS = 65536
MAX_PASSES = 64


def _long_form(df: DataFrame, cols: list[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v"))
                      for i, c in enumerate(cols)])
    return (df.select(F.explode(items).alias("x")).select("x.c", "x.v")
              .where(F.col("v").isNotNull() & ~F.isnan("v")))


def column_stats(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """One pass: per column the NULL/NaN count, -inf and +inf counts, finite
    count and finite min / max. The columns are unpivoted and grouped by
    column index (a handful of aggregates, whatever the column count: a wide
    aggregate with several expressions per column generates far larger code)."""
    if not cols:
        return {}
    items = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v"))
                      for i, c in enumerate(cols)])
    long = df.select(F.explode(items).alias("x")).select("x.c", "x.v")
    v = F.col("v")
    finite = v.isNotNull() & ~F.isnan(v) & ~v.isin(float("inf"), float("-inf"))
    rows = long.groupBy("c").agg(
        F.count_if(v.isNull() | F.isnan(v)).alias("null"),
        F.count_if(v == float("-inf")).alias("neg"),
        F.count_if(v == float("inf")).alias("pos"),
        F.count_if(finite).alias("fin"),
        F.min(F.when(finite, v)).alias("lo"),
        F.max(F.when(finite, v)).alias("hi")).collect()
    by = {r["c"]: r.asDict() for r in rows}
    empty = {"null": 0, "neg": 0, "pos": 0, "fin": 0, "lo": None, "hi": None}
    return {c: {k: by.get(i, empty)[k] for k in empty} for i, c in enumerate(cols)}


def approx_medians(df: DataFrame, cols: list[str], accuracy: int = 10000) -> dict[str, float | None]:
    """One pass with ``percentile_approx`` (bounded sketch per column; rank
    error at most n / accuracy). Returns an actual value of the column, not
    the mean of the two middle values. NULL, NaN and infinities are skipped."""
    if not cols:
        return {}
    long = _long_form(df, cols).where(~F.col("v").isin(float("inf"), float("-inf")))
    rows = long.groupBy("c").agg(F.percentile_approx("v", 0.5, accuracy).alias("m")).collect()
    by = {r["c"]: r["m"] for r in rows}
    return {c: by.get(i) for i, c in enumerate(cols)}


def column_medians(df: DataFrame, cols: list[str], count_infinite: bool = False,
                   stats: dict[str, dict] | None = None) -> dict[str, float | None]:
    """{column: exact median} for the given numeric columns (None if no values).

    ``stats`` (from ``column_stats``, or derived by the caller) saves the first
    pass; per column it may also carry ``infinite`` to override
    ``count_infinite``. Callers should pass a checkpointed / materialised
    frame: it is scanned once per refinement pass (typically one or two).
    """
    if not cols:
        return {}
    spark = df.sparkSession
    long = _long_form(df, cols)
    fin = F.col("v").isin(float("inf"), float("-inf"))
    if stats is None:
        stats = column_stats(df, cols)

    picked: dict[tuple[int, int], float] = {}
    open_rows = []  # (c, t, lo, hi, below, k)
    for i, c in enumerate(cols):
        r = stats.get(c)
        if r is None:
            continue
        if r.get("infinite", count_infinite):
            n, n_neg, n_pos = r["fin"] + r["neg"] + r["pos"], r["neg"], r["pos"]
        else:
            n, n_neg, n_pos = r["fin"], 0, 0
        if n == 0:
            continue
        for t, k in enumerate(((n - 1) // 2, n // 2)):
            if k < n_neg:
                picked[(i, t)] = float("-inf")
            elif k >= n - n_pos:
                picked[(i, t)] = float("inf")
            else:
                kf = k - n_neg
                if r["lo"] == r["hi"]:
                    picked[(i, t)] = float(r["lo"])
                else:
                    open_rows.append((i, t, float(r["lo"]), float(r["hi"]), 0, kf))

    finite = long.where(~fin)
    passes = 0
    while open_rows and passes < MAX_PASSES:
        passes += 1
        state = spark.createDataFrame(open_rows, "c int, t int, lo double, hi double, below long, k long")
        j = finite.join(F.broadcast(state), "c").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        span = F.col("hi") / 2 - F.col("lo") / 2
        b = F.least(F.lit(BUCKETS - 1),
                    F.floor((F.col("v") / 2 - F.col("lo") / 2) / span * F.lit(BUCKETS)).cast("int"))
        agg = (j.groupBy("c", "t", "below", "k", b.alias("b"))
                .agg(F.count(F.lit(1)).alias("cnt"), F.min("v").alias("bmin"), F.max("v").alias("bmax")))
        w = Window.partitionBy("c", "t").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        agg = agg.withColumn("before", F.coalesce(F.sum("cnt").over(w), F.lit(0)) + F.col("below"))
        hit = agg.where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("cnt")))
        nxt = []
        for r in hit.select("c", "t", "bmin", "bmax", "before", "k").collect():
            if r["bmin"] == r["bmax"]:
                picked[(r["c"], r["t"])] = float(r["bmin"])
            else:
                nxt.append((r["c"], r["t"], float(r["bmin"]), float(r["bmax"]), r["before"], r["k"]))
        open_rows = nxt
    if open_rows:  # pragma: no cover - needs > MAX_PASSES passes
        raise RuntimeError("median refinement did not converge")

    out: dict[str, float | None] = {}
    for i, c in enumerate(cols):
        if (i, 0) not in picked:
            out[c] = None
            continue
        a, b2 = picked[(i, 0)], picked[(i, 1)]
        out[c] = a if a == b2 else (a + b2) / 2.0
    return out


def column_medians_frame(df: DataFrame, cols: list[str], count_infinite: bool = False) -> DataFrame:
    """The medians as a one-row DataFrame (columns named as the inputs)."""
    m = column_medians(df, cols, count_infinite)
    return df.sparkSession.createDataFrame([tuple(m[c] for c in cols)],
                                           ", ".join(f"`{c}` double" for c in cols))


# --- medians of groups ----------------------------------------------------------
GROUP_BUCKETS = 1024          # per open group, column and pass
BROADCAST_STATE = 100_000     # open (group, column) rows, counted


def _with_state(rows: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    """Rows of open groups inside their open range, with the range; a few open groups are broadcast."""
    if state.count() <= BROADCAST_STATE:
        state = F.broadcast(state)
    own = state.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(names)], "t", "lo", "hi", "below", "k")
    same = F.col("v").between(F.col("lo"), F.col("hi"))
    for i, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"__s{i}"))
    return rows.join(own, same).drop(*[f"__s{i}" for i in range(len(names))])


def grouped_medians(df: DataFrame, keys: list[str], cols: list[str], buckets: int = GROUP_BUCKETS) -> DataFrame:
    """Exact median of each column in each group: ``keys`` and one double column per name in ``cols``.

    The refinement of ``column_medians`` with a range per (group, column): a
    pass counts the open rows by bucket (partial aggregates, so a group of any
    size is a few rows per task), finds the buckets of the two middle ranks
    with a sum over at most ``buckets`` rows per group, and keeps only the rows
    of those buckets for the next pass. Groups that are done drop out. State
    and rows stay distributed.

    NULL and NaN are skipped, infinities are ordinary values, an even number of
    values gives the mean of the middle two, a group without values NULL. NULL
    is a group of its own.
    """
    names = [f"__k{i}" for i in range(len(keys))] + ["c"]
    group = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    items = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(cols)])
    rows = cut_lineage(df.select(*group, F.explode(items).alias("x")).select(*names[:-1], "x.c", "x.v"))
    all_groups = rows.select(*names[:-1]).distinct()
    rows = rows.where("v IS NOT NULL AND NOT isnan(v)")

    infinite = float("inf")
    finite = F.when(~F.col("v").isin(infinite, -infinite), F.col("v"))
    stats = rows.groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == -infinite).alias("neg"),
        F.count_if(F.col("v") == infinite).alias("pos"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    ranks = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.floor((F.col("n") - 1 + t) / 2).cast("long").alias("k"))
                                for t in (0, 1)]))
    state = cut_lineage(stats.select("*", ranks.alias("r")).select(
        *names, "r.t", "lo", "hi", F.col("neg").alias("below"), "r.k",
        F.when(F.col("r.k") < F.col("neg"), -infinite).when(F.col("r.k") >= F.col("n") - F.col("pos"), infinite)
        .when(F.col("lo") == F.col("hi"), F.col("lo")).alias("found")))
    rows = rows.where(finite.isNotNull())
    done = []
    while True:
        done.append(state.where("found IS NOT NULL").select(*names, "found"))
        state = state.where("found IS NULL")
        if state.isEmpty():
            break
        span = F.col("hi") / 2 - F.col("lo") / 2
        bucket = F.when(span > 0, F.least(F.lit(buckets - 1), F.floor(
            (F.col("v") / 2 - F.col("lo") / 2) / span * buckets).cast("int"))).otherwise(
            F.when(F.col("v") > F.col("lo"), 1).otherwise(0))   # a span below the smallest number
        counts = _with_state(rows, state, names).groupBy(*names, "t", "below", "k", bucket.alias("b")).agg(
            F.count(F.lit(1)).alias("cnt"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        earlier = Window.partitionBy(*names, "t").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("below") + F.coalesce(F.sum("cnt").over(earlier), F.lit(0))
        state = cut_lineage(counts.withColumn("before", before)
                            .where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("cnt")))
                            .select(*names, "t", "lo", "hi", F.col("before").alias("below"), "k",
                                    F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("found")))
        still = state.where("found IS NULL")
        if still.isEmpty():
            continue
        # both ranks of a group may be open in one range: a row is kept once
        ranges = still.groupBy(*names).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(
            "*", *[F.lit(0).alias(c) for c in ("t", "below", "k")])
        rows = cut_lineage(_with_state(rows, ranges, names).select(*names, "v"))

    found = reduce(DataFrame.unionByName, done).groupBy(*names).agg(F.min("found").alias("a"), F.max("found").alias("b"))
    median = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.col("a") + F.col("b")) / 2)
    wide = found.groupBy(*names[:-1]).agg(*[F.max(F.when(F.col("c") == i, median)).alias(f"__m{i}")
                                            for i in range(len(cols))])
    same = reduce(lambda x, y: x & y, [all_groups[n].eqNullSafe(wide[n]) for n in names[:-1]], F.lit(True))
    return all_groups.join(wide, same, "left").select(
        *[all_groups[n].alias(k) for n, k in zip(names, keys)], *[F.col(f"__m{i}").alias(c) for i, c in enumerate(cols)])
