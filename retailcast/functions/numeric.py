"""Null / NaN / infinity handling and rounding, as Column expressions.

Missing values are NULL throughout. Division keeps the distinction the
feature fills depend on: ``x/0`` is a signed infinity, ``0/0`` is missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POS_INF = float("inf")
NEG_INF = float("-inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ieee_div(a, b) -> Column:
    """a / b with IEEE meaning but NULL for NaN: NULL if either side is NULL
    or both are 0, +-Infinity if only b is 0, else the quotient."""
    a, b = _c(a), _c(b)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(b == 0,
              F.when(a == 0, F.lit(None).cast("double"))
              .when(a > 0, F.lit(POS_INF))
              .otherwise(F.lit(NEG_INF)))
        .otherwise(a.cast("double") / b.cast("double"))
    )


def nan_to_null(x) -> Column:
    x = _c(x)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x.cast("double"))


def is_infinite(x) -> Column:
    x = _c(x)
    return x.isin(POS_INF, NEG_INF)



def half_even(x, scale: int = 0) -> Column:
    """Banker's rounding, as NumPy / Python ``round`` do."""
    return F.bround(_c(x), scale)
