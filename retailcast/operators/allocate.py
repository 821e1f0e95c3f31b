"""Allocation of shop-level monthly traffic to (product, month) rows.

W1 share of month, W2 whole-number apportioning, W3 exact money split,
W4 rate copy, W5 estimates for months without traffic.

Everything runs on the aggregated (month, product) rows. Month totals are
partial aggregates broadcast back (one row per calendar month); the
apportioning rank is computed without sorting any month in one task
(``rank_in_group``). Shop-wide ratios are a single aggregate row, inlined as
literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailcast.functions import sqltext as X
from retailcast.functions.numeric import ieee_div
from retailcast.operators.rollup import TrafficSpec, traffic_ratios_global
from retailcast.session import cut_lineage

# Estimated money for months without traffic is damped to 80 %.
ESTIMATE_MONEY_FACTOR = 0.8
MIN_COUNT = 1


def month_share(df: DataFrame, amount: str = "net_amount", month: str = "month",
                out: str = "weight") -> DataFrame:
    """Amount / month total (x/0 -> inf, 0/0 -> NULL). The month totals
    are a partial aggregate (one row per month) joined back to the rows."""
    tot = df.groupBy(month).agg(F.sum(F.col(amount)).alias("__mt"))
    j = df.join(tot, month, "left")
    return j.withColumn(out, ieee_div(F.col(amount), F.col("__mt"))).drop("__mt")


def rank_in_group(df: DataFrame, group: str, order: list, out: str = "__rank") -> DataFrame:
    """0-based position of each row inside its group under ``order``, with one
    shuffle and without sorting a whole group in one task.

    Rows are range-partitioned by (group, order), sorted inside the ranges and
    numbered by Spark's row id before a reliable checkpoint freezes both (range
    bounds come from sampling, so a recomputation could move them). A row's
    rank is its id minus the smallest id of its (partition, group), plus the
    group's rows in earlier partitions: a table of at most partitions + groups
    rows, since a group's stretch is contiguous."""
    # No explicit partition count: the shuffle-partition setting applies and
    # AQE may merge neighbouring ranges, which keeps every partition a
    # contiguous stretch of the order.
    ranged = cut_lineage(df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
                           .withColumn("__id", F.monotonically_increasing_id()))
    pid = F.shiftright("__id", 33)
    stretches = ranged.groupBy(pid.alias("__pid"), F.col(group).alias("__g")).agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy("__g").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = stretches.select("__pid", "__g", (F.coalesce(F.sum("__c").over(before), F.lit(0)) - F.col("__first"))
                             .alias("__shift"))
    j = ranged.join(shift, (pid == F.col("__pid")) & F.col(group).eqNullSafe(F.col("__g")), "left")
    return j.withColumn(out, F.col("__id") + F.col("__shift")).drop("__id", "__pid", "__g", "__shift")


def apportion_counts(df: DataFrame, totals: dict[str, str], *, weight: str = "net_amount",
                     group: str = "month", key: str = "product_key", min_val: int = MIN_COUNT,
                     group_totals: DataFrame | None = None) -> DataFrame:
    """Split each whole-number total over the group's rows by weight.

    ``totals`` maps output column -> SQL expression of the group total.
    base = half-even round(total * w / sum w); the remainder (total - sum of
    bases) is handed out one unit at a time in descending weight (ties by key),
    cycling; then every part is floored at ``min_val``. A NULL or 0 total, or
    zero weights, gives 0 everywhere (no floor). Closed form of the stepwise
    loop: part += sign(d) * (|d| div n + [rank < |d| mod n]).

    Per-group tables have one row per group and carry no hint (AQE decides);
    ``group_totals`` (group, __tw, __n) passes weight sums and row counts that
    are known already. The rank comes from ``rank_in_group``, so no group is
    ever sorted in a single task.
    """
    names = list(totals)
    tmp = df.selectExpr("*", *[f"CAST({t} AS BIGINT) AS `__t_{o}`" for o, t in totals.items()])
    if group_totals is None:
        group_totals = tmp.groupBy(group).agg(F.sum(F.col(weight)).alias("__tw"), F.count(F.lit(1)).alias("__n"))
    tmp = tmp.join(group_totals, group, "left")
    share = X.ieee(X.q(weight), "`__tw`")
    tmp = tmp.selectExpr("*", *[
        f"CASE WHEN `__tw` <> 0 THEN CAST(bround(CAST(`__t_{o}` AS DOUBLE) * {share}, 0) AS BIGINT) END AS `__b_{o}`"
        for o in names])
    g2 = tmp.groupBy(group).agg(*[F.sum(f"__b_{o}").alias(f"__sb_{o}") for o in names])
    tmp = rank_in_group(tmp.join(g2, group, "left"), group,
                        [F.col(weight).desc(), F.col(key).asc()])
    parts = []
    for o in names:
        d = f"(`__t_{o}` - `__sb_{o}`)"
        parts.append(
            f"CASE WHEN `__t_{o}` IS NULL OR `__t_{o}` = 0 OR `__tw` IS NULL OR `__tw` = 0 THEN CAST(0 AS BIGINT) "
            f"ELSE greatest(`__b_{o}` + CAST(signum({d}) AS BIGINT) * (CAST(floor(abs({d}) / `__n`) AS BIGINT) "
            f"+ CASE WHEN `__rank` < abs({d}) % `__n` THEN 1 ELSE 0 END), CAST({min_val} AS BIGINT)) END AS {X.q(o)}")
    own = ({"__tw", "__n", "__rank"} | {f"__t_{o}" for o in names} | {f"__b_{o}" for o in names}
           | {f"__sb_{o}" for o in names})
    keep = [X.q(c) for c in tmp.columns if c not in own and c not in names]
    return tmp.selectExpr(*keep, *parts)


def allocate_traffic(monthly: DataFrame, traffic_monthly: DataFrame, spec: TrafficSpec | None = None,
                     cutoff: str | None = None, amount: str = "net_amount") -> DataFrame:
    """W1-W5 in one plan: join monthly traffic onto (month, product) sales,
    split counts as whole numbers, money exactly by share, copy rates; for
    months before ``cutoff`` (default: first traffic month) estimate counts
    from the shop-wide count-per-sale, money at 80 % of the shop-wide ratio,
    and rates as the shop-wide mean."""
    s = spec or TrafficSpec()
    counts, money, rates = list(s.counts), list(s.money), list(s.rate_text)
    # Month-grain traffic (one row per calendar month) feeds the shop-wide
    # ratios and the join: materialise it once instead of aggregating twice.
    traffic_monthly = cut_lineage(traffic_monthly)
    # The shop-wide ratios are one aggregate row (a fixed set of scalars):
    # computed once and inlined as literals, so every row reads them without
    # a join and the traffic aggregate is not re-planned per reference.
    g = traffic_ratios_global(traffic_monthly, s, with_first_month=True).first().asDict()
    lit = {c: ("CAST(NULL AS DOUBLE)" if v is None else f"CAST({float(v)!r} AS DOUBLE)")
           for c, v in g.items() if c != "first_month"}
    cut_v = cutoff if cutoff is not None else g["first_month"]
    cut = f"DATE '{cut_v}'" if cut_v is not None else "CAST(NULL AS DATE)"

    # The roll-up is read several times below: materialise it, so that the
    # order lines are scanned once. Month totals and row counts are taken once.
    monthly = cut_lineage(monthly)
    totals = cut_lineage(monthly.groupBy("month").agg(F.sum(F.col(amount)).alias("__tw"),
                                                      F.count(F.lit(1)).alias("__n")))
    a = X.q(amount)
    j = monthly.join(traffic_monthly.drop("total_sales"), "month", "left")
    j = j.join(totals.select("month", F.col("__tw").alias("__msales")), "month", "left")
    early = f"(`month` < {cut})"
    share = X.ieee(a, "`__msales`")
    est = {c: f"greatest(CAST(1 AS BIGINT), CAST(bround(CAST(`__msales` AS DOUBLE) * {lit[c + '_per_sale']}, 0) AS BIGINT))"
           for c in counts}
    j = j.selectExpr(*[X.q(c) for c in j.columns if c not in counts],
                     *[f"CASE WHEN {early} THEN {est[c]} ELSE {X.q(c)} END AS `__total_{c}`" for c in counts])
    j = apportion_counts(j, {c: f"`__total_{c}`" for c in counts}, weight=amount,
                         group_totals=totals)
    fills = {}
    for c in money:
        fills[c] = (f"CASE WHEN {early} THEN {share} * ((CAST(`__msales` AS DOUBLE) * {lit[c + '_per_sale']}) "
                    f"* {ESTIMATE_MONEY_FACTOR!r}) ELSE {share} * {X.q(c)} END")
    for c in rates:
        fills[c] = f"CASE WHEN {early} THEN {lit['avg_' + c]} ELSE {X.q(c)} END"
    for c in counts:
        fills[c] = f"CAST(coalesce({X.q(c)}, 0) AS BIGINT)"
    cols = [f"{fills[c]} AS {X.q(c)}" if c in fills else X.q(c)
            for c in j.columns if not c.startswith("__")]
    return j.selectExpr(*cols)
