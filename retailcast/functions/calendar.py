"""Month arithmetic on DATE columns (a month is its first day)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_start(x) -> Column:
    """First day of the month as DATE (``trunc`` keeps DATE, unlike date_trunc)."""
    return F.trunc(F.to_date(_c(x)), "MM")


def month_text(x) -> Column:
    return F.date_format(_c(x), "yyyy-MM")


def month_from_text(x) -> Column:
    """'yyyy-MM' -> DATE; bad text -> NULL."""
    return F.try_to_date(F.concat(_c(x), F.lit("-01")), "yyyy-MM-dd")
