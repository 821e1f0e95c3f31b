"""Product keys: ``<product> - <variant>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separator and the label for a missing variant.
KEY_SEPARATOR = " - "
NO_VARIANT_LABEL = "Tidak ada variasi"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def product_key(product, variant=None, no_variant: str = NO_VARIANT_LABEL) -> Column:
    """Strict key: missing variant -> label; missing product -> NULL key
    (string concat with NULL is NULL, so such rows drop out of roll-ups)."""
    p = _c(product)
    if variant is None:
        return p.cast("string")
    return F.concat(p.cast("string"), F.lit(KEY_SEPARATOR),
                    F.coalesce(_c(variant).cast("string"), F.lit(no_variant)))


def product_key_lenient(product, variant=None) -> Column:
    """Lenient key: missing variant -> '' (key ends in ' - '), missing product
    -> the text 'nan'; without a variant column the key is the product."""
    p = F.coalesce(_c(product).cast("string"), F.lit("nan"))
    if variant is None:
        return p
    return F.concat(p, F.lit(KEY_SEPARATOR), F.coalesce(_c(variant).cast("string"), F.lit("")))
