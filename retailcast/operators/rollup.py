"""Grouped roll-ups with a map-side partial step, so a hot key costs one partial
row per map task. They are hash aggregates except minima and maxima of text,
which sort. Medians are refined in passes (``medians.py``). Money is summed as
DECIMAL: exact, hence independent of partitioning."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.functions.calendar import month_start, month_text
from retailcast.functions.numeric import ieee_div
from retailcast.functions.text import parse_localized_number, parse_percent
from retailcast.operators.medians import grouped_medians

MONEY = "decimal(38,6)"


def money_sum(c) -> Column:
    """Exact sum of a money column (NULL-only group -> 0, as pandas does)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c.cast(MONEY)), F.lit(0).cast(MONEY))


def count_sum(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


# --- A1 ---------------------------------------------------------------------
def monthly_product_sales(df: DataFrame, *, key: str = "product_key", month: str = "month",
                          qty: str = "qty", amount: str = "net_price", scale: int = 1000) -> DataFrame:
    """Quantity and scaled net amount per (month, product).

    NULL keys and months are dropped first (pandas groupby drops them).
    ``net_amount`` is sum(amount) * scale truncated to a whole number and
    ``sales_amount`` is the same value under the traffic-facing name.
    """
    g = monthly_sales_with_first(df, key=key, month=month, qty=qty, amount=amount, scale=scale)
    return g.where(F.col("month").isNotNull()).drop("first_order")


def monthly_sales_with_first(df: DataFrame, *, key: str = "product_key", month: str = "month",
                             qty: str = "qty", amount: str = "net_price", scale: int = 1000,
                             order_by: str | None = None) -> DataFrame:
    """The (month, product) aggregate, optionally with the smallest value of
    the leading order column (``first_order``, a fixed-width type, so that the
    roll-up stays a hash aggregate). Rows with a NULL month are kept here, as
    their own group, so the first row of a product is exact;
    ``monthly_product_sales`` drops them."""
    aggs = [count_sum(qty).alias("qty"), (money_sum(amount) * F.lit(scale)).cast("long").alias("net_amount")]
    aggs.append(F.min(order_by).alias("first_order") if order_by else F.lit(None).alias("first_order"))
    g = (df.where(F.col(key).isNotNull())
           .groupBy(F.col(month).alias("month"), F.col(key).alias("product_key")).agg(*aggs))
    return g.withColumn("sales_amount", F.col("net_amount"))


#: Products up to which the first orders are sent to all tasks (about 100 bytes each).
BROADCAST_PRODUCTS = 100_000


def product_info_from_monthly(agg: DataFrame, lines: DataFrame, cols: list[str], order_cols: list[str],
                              key: str = "product_key") -> DataFrame:
    """A10: one row per product, its first in source order.

    ``agg`` carries the smallest leading order value of each (month, product);
    only the lines that hold a product's smallest one are fetched, by a join
    on pruned columns, and compared by the whole order. Neither step sorts or
    gathers the order lines. The order columns must tell a product's rows
    apart: lines that tie in the first two are gathered.
    """
    first = agg.groupBy(F.col(key).alias("__key")).agg(F.min("first_order").alias("__lead"))
    small = first.count() <= BROADCAST_PRODUCTS
    found = lines.select(key, *dict.fromkeys([*order_cols, *cols]))
    for i, c in enumerate(order_cols[:2]):
        if i:   # lines that share the leading value: go on with the second
            first = found.groupBy(F.col(key).alias("__key")).agg(F.min(c).alias("__lead"))
        side = F.broadcast(first) if small else first
        found = found.join(side, (F.col(key) == F.col("__key")) & F.col(c).eqNullSafe(F.col("__lead"))).drop(
            "__key", "__lead")
    # the few lines that agree in both
    best = F.array_min(F.collect_list(F.struct(
        F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)]).alias("order"),
        F.struct(*[F.col(c) for c in cols]).alias("row")))).alias("first")
    return found.groupBy(key).agg(best).select(key, *[F.col(f"first.row.{c}").alias(c) for c in cols])


# --- A2 / A4 ----------------------------------------------------------------
_AGG_FUNCS = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "exact_sum": lambda c: money_sum(c).cast("double"),   # doubles: the same whatever the partitioning
    "mean": F.avg,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "nunique": F.count_distinct,
}


def monthly_rollup(df: DataFrame, date_col: str | None, group_cols: list[str],
                   aggs: dict[str, str | list[str]]) -> DataFrame:
    """Month ('yyyy-MM' text) + group columns + {column: function or list of functions}.

    Output columns are named after the input columns, with several functions
    after both (``qty_sum``, ``qty_mean``); ``{'*': 'size'}`` counts rows as
    ``row_count``. Sums of doubles are exact (decimal), so they do not depend
    on partitioning, and so are medians (``grouped_medians``: passes of their
    own over the columns that need them). Distinct counts keep an entry per
    value: their rows are first dealt evenly to tasks that do nothing else, so
    the entries do not come on top of the sorts of the joins before. Without a
    date column the result is empty.
    """
    if not date_col or date_col not in df.columns:
        return df.sparkSession.createDataFrame([], "month string")
    m = month_text(month_start(F.col(date_col)))
    keys = [m.alias("month")] + [F.col(c) for c in group_cols]
    cond = F.col(date_col).isNotNull()
    for c in group_cols:
        cond = cond & F.col(c).isNotNull()
    exprs, medians, names = [], {}, []
    kinds = dict(df.dtypes)
    for c, fns in aggs.items():
        for fn in [fns] if isinstance(fns, str) else fns:
            if fn == "size":
                names.append("row_count")
                exprs.append(F.count(F.lit(1)).alias("row_count"))
                continue
            names.append(c if isinstance(fns, str) else f"{c}_{fn}")
            if fn == "median":
                medians[names[-1]] = c
                continue
            exact = fn == "sum" and kinds[c] in ("double", "float")
            exprs.append(_AGG_FUNCS["exact_sum" if exact else fn](F.col(c)).alias(names[-1]))
    kept = df.where(cond)
    if any("nunique" in ([fns] if isinstance(fns, str) else fns) for fns in aggs.values()):
        # by all columns that are read, so a hot key is spread
        read = list(dict.fromkeys([date_col, *group_cols, *[c for c in aggs if c != "*"]]))
        kept = kept.select(*[F.col(c) for c in read]).repartition(*[F.col(c) for c in read])
    if not medians:
        return kept.groupBy(*keys).agg(*exprs)
    own = ["month", *group_cols]
    middle = grouped_medians(kept.select(*keys, *[F.col(c).alias(f"__{n}") for n, c in medians.items()]), own,
                             [f"__{n}" for n in medians]).withColumnsRenamed({f"__{n}": n for n in medians})
    rest = kept.groupBy(*keys).agg(*(exprs or [F.count(F.lit(1)).alias("__rows")]))
    return rest.join(middle, own).select(*own, *names)


def monthly_row_counts(df: DataFrame, date_col: str, group_cols: list[str] | None = None) -> DataFrame:
    """Fallback roll-up when no measure column exists: rows per month (and keys)."""
    return monthly_rollup(df, date_col, group_cols or [], {"*": "size"})


# --- A3 ---------------------------------------------------------------------
@dataclass
class TrafficSpec:
    """Which traffic columns are counts, money, means of money text and rates.

    Keys are the output names, values the input columns.
    """
    date: str = "date_text"
    date_formats: tuple[str, ...] = ("d/M/yyyy", "d-M-yyyy", "yyyy-MM-dd", "d.M.yyyy")
    total_sales_text: str = "sales_text"
    counts: dict[str, str] = field(default_factory=lambda: {
        "orders": "orders", "views": "views", "visitors": "visitors",
        "cancelled_orders": "cancelled_orders", "returned_orders": "returned_orders",
        "buyers": "buyers", "new_buyers": "new_buyers", "current_buyers": "current_buyers",
        "potential_buyers": "potential_buyers"})
    money: dict[str, str] = field(default_factory=lambda: {
        "cancelled_sales": "cancelled_sales", "returned_sales": "returned_sales"})
    mean_money_text: dict[str, str] = field(default_factory=lambda: {
        "sales_per_order": "sales_per_order_text"})
    rate_text: dict[str, str] = field(default_factory=lambda: {
        "conversion_rate": "conversion_rate_text", "repeat_rate": "repeat_rate_text"})


def parse_day_first(text: Column, formats) -> Column:
    """Day-first date text -> DATE; the first format that parses wins."""
    return F.coalesce(*[F.try_to_date(text.cast("string"), f) for f in formats])


def monthly_traffic(traffic: DataFrame, spec: TrafficSpec | None = None) -> DataFrame:
    """Shop traffic per month: sums of counts and money, means of rates and of
    amount per order. Text numbers are parsed first; junk becomes NULL. A
    column that the table lacks counts as missing values."""
    s = spec or TrafficSpec()
    absent = {c for c in (*s.counts.values(), *s.money.values(), *s.mean_money_text.values(), *s.rate_text.values())
              if c not in traffic.columns}
    traffic = traffic.withColumns({c: F.lit(None).cast("string" if c.endswith("_text") else "double") for c in absent})
    m = month_start(parse_day_first(F.col(s.date), s.date_formats))
    exprs = [money_sum(parse_localized_number(F.col(s.total_sales_text))).cast("double").alias("total_sales")]
    exprs += [count_sum(F.col(c)).alias(o) for o, c in s.counts.items()]
    exprs += [money_sum(F.col(c)).cast("double").alias(o) for o, c in s.money.items()]
    exprs += [F.avg(parse_localized_number(F.col(c))).alias(o) for o, c in s.mean_money_text.items()]
    exprs += [F.avg(parse_percent(F.col(c))).alias(o) for o, c in s.rate_text.items()]
    return (traffic.withColumn("month", m).where(F.col("month").isNotNull())
                   .groupBy("month").agg(*exprs))


# --- A5 ---------------------------------------------------------------------
def traffic_ratios_global(traffic_monthly: DataFrame, spec: TrafficSpec | None = None,
                          with_first_month: bool = False) -> DataFrame:
    """One row: mean of each rate over months, and for each count / money
    metric its total per unit of total traffic sales (0 if that total is 0);
    optionally the first traffic month too."""
    s = spec or TrafficSpec()
    tot = F.sum(F.col("total_sales").cast(MONEY)).cast("double")
    exprs = [F.avg(F.col(o)).alias(f"avg_{o}") for o in s.rate_text]
    for o in list(s.counts) + list(s.money):
        exprs.append(F.when(F.coalesce(tot, F.lit(0.0)) == 0, F.lit(0.0))
                     .otherwise(F.sum(F.col(o).cast(MONEY)).cast("double") / tot)
                     .alias(f"{o}_per_sale"))
    if with_first_month:
        exprs.append(F.min("month").alias("first_month"))
    return traffic_monthly.agg(*exprs)


# --- A9 ---------------------------------------------------------------------
def dataset_summary(df: DataFrame, key: str = "product_key", month: str = "month",
                    qty: str = "qty") -> DataFrame:
    """Rows, distinct products, month span (days // 30), total quantity."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.col(key)).alias("n_products"),
        F.min(month).alias("first_month"),
        F.max(month).alias("last_month"),
        F.floor(F.datediff(F.max(month), F.min(month)) / 30).cast("long").alias("month_span"),
        count_sum(qty).alias("total_qty"),
    )


# --- A10 --------------------------------------------------------------------
def product_info_first(df: DataFrame, cols: list[str], order_cols: list[str],
                       key: str = "product_key") -> DataFrame:
    """First row per product in source order, for the given columns (exact
    'keep first' semantics, unlike ``dropDuplicates``)."""
    lines = df.where(F.col(key).isNotNull())
    lead = lines.groupBy(key).agg(F.min(order_cols[0]).alias("first_order"))
    return product_info_from_monthly(lead, lines, cols, order_cols, key)


# --- A11 --------------------------------------------------------------------
def product_list(df: DataFrame, key: str = "product_key") -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(key).distinct()



# --- A14 --------------------------------------------------------------------
def forecast_totals(fc: DataFrame, key: str = "product_key", value: str = "forecast") -> DataFrame:
    return fc.groupBy(key).agg(
        count_sum(value).alias("total_forecast"),
        F.avg(F.col(value)).alias("mean_forecast"),
        F.count(F.lit(1)).alias("horizon"))


# --- O3 ---------------------------------------------------------------------
def top_products(monthly: DataFrame, n: int, key: str = "product_key", qty: str = "qty") -> DataFrame:
    """The n best-selling products (a top-k report: the limit is the feature).
    Spark plans orderBy+limit as TakeOrderedAndProject: k rows per task."""
    return (monthly.groupBy(key).agg(count_sum(qty).alias("total_qty"))
                   .orderBy(F.col("total_qty").desc(), F.col(key).asc()).limit(n))
