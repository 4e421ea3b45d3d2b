"""SKU suggestions for a search box."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rmalytics.functions.keys import keyed_sums
from rmalytics.functions.text import matches


def suggest_skus(returns: DataFrame, term: str, n: int = 10, literal: bool = False,
                 fold_case: bool = True) -> DataFrame:
    """First ``n`` distinct SKUs (alphabetical) containing ``term``
    (case-insensitive, not trimmed). A blank term gives no rows.
    Plan: filtered scan -> partial/final distinct -> top-n. With
    ``fold_case`` SKUs differing only in letter case count once."""
    if not term:
        return returns.select("merchant_sku").limit(0)
    hits = returns.filter(matches(returns, term, "merchant_sku", literal=literal))
    return keyed_sums(hits, ["merchant_sku"], {}, fold_case).select("merchant_sku") \
        .orderBy("merchant_sku").limit(n)
