"""Export of units returned per (asin, merchant_sku) in a date range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rmalytics.functions.dates import month_window_filter
from rmalytics.functions.keys import keyed_sums


def export_returns(returns: DataFrame, start, end, fold_case: bool = True) -> DataFrame:
    """Month-granular range: a month counts when its first day lies in
    [start, end]. Start 2024-01-15 leaves January out; end 2024-03-01
    takes all of March. Columns: asin, merchant_sku, return_quantity.

    With ``fold_case`` SKUs differing only in letter case are one row, shown
    in their smallest spelling.
    """
    r = returns.filter(month_window_filter(start, end))
    g = keyed_sums(r, ["asin", "merchant_sku"], {"return_quantity": F.col("return_quantity")}, fold_case)
    return g.select("asin", "merchant_sku", F.col("return_quantity").cast("bigint").alias("return_quantity"))
