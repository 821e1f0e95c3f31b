"""Joins. Distinct holiday days and months are broadcast: their number is bounded
by the calendar span. All other tables carry no hint and AQE picks the strategy
from runtime sizes; ``safe_join`` can split hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.functions.calendar import month_text
from retailcast.operators.skew import hot_keys, split_join


def parse_holiday_dates(holidays: DataFrame, date_col: str = "date_text",
                        formats=("M/d/yyyy", "yyyy-MM-dd", "d/M/yyyy")) -> DataFrame:
    """Holiday text dates -> DATE column ``holiday_date`` (bad -> NULL).

    One format holds for the whole column: the one that parses most rows, the
    earlier one in a tie. The holiday table is a calendar, so one small count.
    """
    text = F.col(date_col).cast("string")
    counts = holidays.agg(*[F.count(F.try_to_date(text, f)).alias(f"f{i}") for i, f in enumerate(formats)]).first()
    best = max(range(len(formats)), key=lambda i: (counts[i], -i))
    return holidays.withColumn("holiday_date", F.try_to_date(text, formats[best]))


def holiday_day_flag(df: DataFrame, holidays: DataFrame, date_col: str = "pay_date",
                     out: str = "is_holiday") -> DataFrame:
    """Flag rows whose date is a holiday. Holidays are calendar days, so the
    distinct set is bounded by the calendar span: broadcast."""
    h = holidays if "holiday_date" in holidays.columns else parse_holiday_dates(holidays)
    days = (h.select(F.col("holiday_date").alias("__hday")).where(F.col("__hday").isNotNull())
             .distinct())
    j = df.join(F.broadcast(days), F.col(date_col) == F.col("__hday"), "left")
    return j.withColumn(out, F.col("__hday").isNotNull()).drop("__hday")


def holiday_month_flag(df: DataFrame, holidays: DataFrame | None, month_col: str = "month",
                       out: str = "is_holiday_month") -> DataFrame:
    """Flag rows whose month holds a holiday; False when no holiday dates."""
    if holidays is None:
        return df.withColumn(out, F.lit(False))
    h = holidays if "holiday_date" in holidays.columns else parse_holiday_dates(holidays)
    months = (h.select(month_text(F.col("holiday_date")).alias("__hmonth"))
               .where(F.col("__hmonth").isNotNull()).distinct())
    mt = F.col(month_col) if dict(df.dtypes)[month_col] == "string" else month_text(F.col(month_col))
    j = df.join(F.broadcast(months), mt == F.col("__hmonth"), "left")
    return j.withColumn(out, F.col("__hmonth").isNotNull()).drop("__hmonth")


def sales_traffic_join(monthly_sales: DataFrame, traffic_monthly: DataFrame,
                       drop_right: tuple[str, ...] = ("total_sales",)) -> DataFrame:
    """Monthly sales LEFT JOIN monthly traffic on month; the right side's copy
    of the sales total is dropped. One traffic row per month; AQE decides."""
    right = traffic_monthly.drop(*[c for c in drop_right if c in traffic_monthly.columns])
    return monthly_sales.join(right, "month", "left")


def sales_product_info_join(monthly: DataFrame, info: DataFrame, key: str = "product_key") -> DataFrame:
    return monthly.join(info, key, "left")


def sales_stock_join(monthly: DataFrame, stock: DataFrame, cols: list[str],
                     key: str = "product_key", month_key: str = "month_text") -> DataFrame:
    """LEFT JOIN stock status on (product, month text), pruned to ``cols``."""
    right = stock.select(F.col(key).alias("__stock_key"), F.col(month_key).alias("__stock_month"), *cols)
    left = monthly.withColumn("__sales_month", month_text(F.col("month")))
    cond = (F.col(key) == F.col("__stock_key")) & (F.col("__sales_month") == F.col("__stock_month"))
    return left.join(right, cond, "left").drop("__sales_month", "__stock_month", "__stock_key")


def safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
              suffixes: tuple[str, str] = ("_x", "_y"), hot_share: float | None = None) -> DataFrame:
    """General equi-join with the tolerant rules of the source:

    * only key columns present on both sides are used; none -> ``left``;
    * ``how`` outside left/right/outer/inner -> left;
    * NULL keys match each other (null-safe equality), as pandas merge does;
    * other clashing names get ``suffixes``; key columns appear once.

    A cross product is never built: ``how='cross'`` with keys is rejected,
    as the source's merge rejects it.

    With ``hot_share``, keys that hold at least that share of a side's rows
    (NULL may be one) are found first and joined in pieces (``skew.py``); the
    rows are the same. ``skew.hot_keys`` tells beforehand how many they make.
    """
    keys = [k for k in on if k in left.columns and k in right.columns]
    if not keys:
        return left
    if how == "cross":
        raise ValueError("how='cross' cannot be combined with join keys")
    if how not in ("left", "right", "outer", "inner"):
        how = "left"
    hot = hot_keys(left, right, keys, hot_share) if hot_share is not None else []
    if hot:
        j, l, r = split_join(left, right, keys, how, hot), "l", "r"
    else:
        l, r = "__l", "__r"
        cond = reduce(lambda x, y: x & y, [F.col(f"{l}.`{k}`").eqNullSafe(F.col(f"{r}.`{k}`")) for k in keys])
        j = left.alias(l).join(right.alias(r), cond, "full_outer" if how == "outer" else how)
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    out = []
    for k in keys:
        if how == "outer":
            out.append(F.coalesce(F.col(f"{l}.`{k}`"), F.col(f"{r}.`{k}`")).alias(k))
        else:
            out.append(F.col(f"{r if how == 'right' else l}.`{k}`").alias(k))
    for side, df, suffix in ((l, left, suffixes[0]), (r, right, suffixes[1])):
        out += [F.col(f"{side}.`{c}`").alias(c + suffix if c in clash else c) for c in df.columns if c not in keys]
    return j.select(*out)
