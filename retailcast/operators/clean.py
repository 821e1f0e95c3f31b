"""Row-level cleaning of order lines (no shuffles here)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from retailcast.functions.calendar import month_start
from retailcast.functions.keys import product_key, product_key_lenient
from retailcast.functions.numeric import ieee_div

# The status that marks a cancelled order.
CANCELLED_STATUS = "Batal"


# Forms of payment times in text.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def with_product_key(df: DataFrame, product: str = "product", variant: str | None = "variant",
                     lenient: bool = False, out: str = "product_key") -> DataFrame:
    has_variant = variant is not None and variant in df.columns
    v = F.col(variant) if has_variant else None
    key = product_key_lenient(F.col(product), v) if lenient else product_key(F.col(product), v)
    return df.withColumn(out, key)


def drop_cancelled(df: DataFrame, status: str = "status", value: str = CANCELLED_STATUS,
                   report: Observation | None = None) -> DataFrame:
    """Drop rows whose status equals ``value``; rows with NULL status stay.

    ``report`` (a ``pyspark.sql.Observation``) receives ``rows`` and
    ``dropped`` when the result is computed, without a pass of its own.
    """
    cancelled = F.col(status).eqNullSafe(F.lit(value))
    if report is not None:
        df = df.observe(report, F.count(F.lit(1)).alias("rows"),
                        F.count(F.when(cancelled, 1)).alias("dropped"))
    return df.where(~cancelled)


def with_order_month(df: DataFrame, ts: str = "paid_at") -> DataFrame:
    """Payment date and month start (both DATE). Text is read in the
    unambiguous year-first forms; what does not parse is NULL."""
    c = F.col(ts)
    if dict(df.dtypes)[ts] == "string":
        c = F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in TIME_FORMATS])
    return df.withColumns({"pay_date": F.to_date(c), "month": month_start(c)})


def unit_price(net: str = "net_price", qty: str = "qty") -> Column:
    return ieee_div(F.col(net), F.col(qty))


def discount_pct(list_price: str = "list_price", net: str = "net_price") -> Column:
    """(list - net) / list * 100; missing (0/0 or NULL) -> 0, x/0 stays +-inf."""
    return F.coalesce(ieee_div(F.col(list_price) - F.col(net), F.col(list_price)) * F.lit(100.0),
                      F.lit(0.0))


def scaled_amount(x, factor: int = 1000) -> Column:
    """x * factor truncated toward zero (the currency scale of the source)."""
    c = F.col(x) if isinstance(x, str) else x
    return (c.cast("decimal(38,6)") * F.lit(factor)).cast("long")


def prepare_sales(sales: DataFrame, holidays: DataFrame | None = None, *,
                  ts: str = "paid_at", lenient_key: bool = False) -> DataFrame:
    """Key, cancellation filter, dates, holiday-day flag, unit price and
    discount, in the order the notebook path applies them."""
    df = with_product_key(sales, lenient=lenient_key)
    df = drop_cancelled(df)
    df = with_order_month(df, ts)
    if holidays is not None:
        from retailcast.operators.joins import holiday_day_flag
        df = holiday_day_flag(df, holidays, date_col="pay_date")
    return df.withColumns({"unit_price": unit_price(), "discount_pct": discount_pct()})
