"""Localized number text: ``1.234,5`` (dot thousands, comma decimal),
``2,34%`` and ``1.200 gr``. Bad text becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retailcast.functions.numeric import nan_to_null

# The unit suffix stripped from weight text.
WEIGHT_SUFFIX = " gr"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _to_double(text: Column) -> Column:
    # try_cast turns junk into NULL; 'nan' parses to NaN, which is missing too.
    return nan_to_null(text.try_cast("double"))


def parse_localized_number(x) -> Column:
    """Drop every '.', turn ',' into '.', parse as double."""
    s = _c(x).cast("string")
    s = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return _to_double(s)


def parse_percent(x) -> Column:
    """Drop '%', turn ',' into '.', parse (2,34% -> 2.34)."""
    s = _c(x).cast("string")
    s = F.replace(F.replace(s, F.lit("%"), F.lit("")), F.lit(","), F.lit("."))
    return _to_double(s)


def parse_weight(x, suffix: str = WEIGHT_SUFFIX) -> Column:
    """Drop the unit suffix, then parse as a localized number."""
    s = F.replace(_c(x).cast("string"), F.lit(suffix), F.lit(""))
    return parse_localized_number(s)


def format_thousands(whole) -> Column:
    """A whole number as text with '.' between thousands (1234567 -> 1.234.567)."""
    return F.replace(F.format_number(_c(whole).cast("long"), 0), F.lit(","), F.lit("."))


def format_localized_cents(cents) -> Column:
    """Integer hundredths as ``1.234,56`` (exact: no float rounding)."""
    c = _c(cents).cast("long")
    whole = F.floor(c / 100).cast("long")
    frac = F.pmod(c, F.lit(100))
    return F.concat(format_thousands(whole), F.lit(","), F.lpad(frac.cast("string"), 2, "0"))


def format_percent_bp(bp) -> Column:
    """Integer basis points as ``x,yy%``."""
    b = _c(bp).cast("long")
    return F.concat(F.floor(b / 100).cast("long").cast("string"), F.lit(","),
                    F.lpad(F.pmod(b, F.lit(100)).cast("string"), 2, "0"), F.lit("%"))
