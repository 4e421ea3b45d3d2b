"""Display helpers: the numbers as the dashboard shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct_text(rate: Column) -> Column:
    """33.33 -> '33.33%'; NULL -> 'N/A'."""
    return F.when(rate.isNull(), F.lit("N/A")).otherwise(F.format_string("%.2f%%", rate))


def count_text(n: Column) -> Column:
    """1234567 -> '1,234,567'."""
    return F.format_number(n, 0)


def product_link(asin: Column, base: str) -> Column:
    """``base`` + ASIN, e.g. base 'https://<marketplace>/dp/'."""
    return F.concat(F.lit(base), asin)
