"""Product search: return counts, units sold and return rates per year,
with the breakdown by return reason.

All outputs come from one filtered scan of ``returns`` (cache ``matched``
if several outputs are collected). Counts here are return *rows*
(``returns_<y>``), sales are *units* (``sales_<y>``), as in the source
application.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rmalytics.functions.keys import key_of, keyed_pairs, keyed_sums, spelling
from rmalytics.functions.membership import key_filter, may_hold
from rmalytics.functions.rates import has_returns, rate_band, return_rate
from rmalytics.functions.text import matches


class SearchResult:
    """Outputs of one search; all built from the same filtered ``matched``.

    ``products`` is built at once; the other outputs are built on first use.
    """

    def __init__(self, matched: DataFrame, unsorted_products: DataFrame, years: tuple[int, ...],
                 fold_case: bool):
        self.matched = matched    # returns rows whose SKU or ASIN contains the term
        self.years = years
        self.fold_case = fold_case
        self._unsorted = unsorted_products
        self.products = _product_order(unsorted_products, years)  # one row per ASIN

    @cached_property
    def reasons(self) -> DataFrame:
        """One row per (ASIN, reason)."""
        return return_reasons(self.matched, self.years, self.fold_case)

    @cached_property
    def summary(self) -> DataFrame:
        """One row of totals and rates."""
        return search_summary(self._unsorted, self.years)

    @cached_property
    def combined_reasons(self) -> DataFrame:
        """One row per reason over all matched products."""
        return combined_reasons(self.matched, self.years, self.fold_case)

    def persist(self) -> "SearchResult":
        """Keep the matched rows (memory, spilling to disk) while several
        outputs are collected; a lost block is recomputed from the table."""
        self.matched.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        self.matched.unpersist()

    def products_with_reasons(self) -> DataFrame:
        """``products`` with a ``return_reasons`` list, in the same order."""
        nested = nest_reasons(self._unsorted, self.reasons, self.years, self.fold_case)
        return _product_order(nested, self.years)


def _year_sums(years, value=None, prefix="returns") -> dict:
    """{<prefix>_<y>: value (1 = a row) when the row's year is y, else 0}."""
    one = F.lit(1) if value is None else F.col(value)
    return {f"{prefix}_{y}": F.when(F.col("year") == y, one).otherwise(0) for y in years}


def search_products(returns: DataFrame, sales: DataFrame, term: str, years=(2023, 2024),
                    literal: bool = False, fold_case: bool = True) -> SearchResult:
    """Search ``term`` (trimmed; blank -> no products) in merchant_sku or asin.

    products: asin, merchant_skus (distinct, sorted, comma joined),
    returns_<y>, sales_<y>, return_rate_<y> (half-up, NULL without sales),
    ordered by returns of the last year descending, then asin. Sales are the
    whole ASIN's, even when only one of its SKUs matched. Matching ignores
    letter case and accents; so does grouping unless ``fold_case=False``.
    ``merchant_skus`` is NULL only where every SKU is NULL: a blank SKU is ''.

    Sales of ASINs that can't be among the products are left out in the scan
    (``functions/membership.py``; the filter is built from the products' own
    first shuffle, so ``returns`` is scanned once). The others are summed by
    ASIN before they are shuffled (one row per ASIN and task, so a hot ASIN is
    no more than others) and then meet the products.
    """
    years = tuple(int(y) for y in years)
    term = (term or "").strip()
    matched = returns.filter(matches(returns, term, "merchant_sku", "asin", literal=literal)) if term \
        else returns.limit(0)

    # (asin, sku) first: collapses a hot ASIN to one row per SKU map-side,
    # then (asin) over that small input.
    per_sku = keyed_sums(matched, ["asin", "merchant_sku"], _year_sums(years), fold_case)
    per_asin = per_sku.groupBy("asin_key").agg(
        F.array_sort(F.collect_list("merchant_sku")).alias("_skus"),
        *([spelling("asin").alias("asin")] if fold_case else []),
        *[F.sum(f"returns_{y}").cast("bigint").alias(f"returns_{y}") for y in years])
    if not fold_case:
        per_asin = per_asin.withColumn("asin", F.col("asin_key"))
    per_asin = per_asin.withColumn("merchant_skus", F.when(F.size("_skus") > 0, F.array_join("_skus", ","))).drop("_skus")

    # Rows of other years add 0 to every sales_<y>, so only the wanted
    # years' partitions are read.
    sales_y = sales.filter(F.col("year").isin(*years)) if years else sales.limit(0)
    sales_y = sales_y.select(key_of(sales_y, "asin", fold_case).alias("asin_key"), "year", "quantity")
    if years:
        # the sums (always 0 or more) keep this branch equal to the products', whose shuffle it reuses
        pairs = keyed_pairs(matched, ["asin", "merchant_sku"], _year_sums(years), fold_case)
        found = pairs.where(sum(F.col(f"returns_{y}") for y in years) >= 0)
        sales_y = sales_y.where(may_hold(key_filter(F.col("asin_key"), found).scalar(), F.col("asin_key")))
    sold = sales_y.groupBy("asin_key").agg(
        *[F.sum(e).cast("bigint").alias(n) for n, e in _year_sums(years, "quantity", "sales").items()])

    j = per_asin.join(sold, "asin_key", "left")
    cols = ["asin", "merchant_skus"]
    for y in years:
        s = F.coalesce(F.col(f"sales_{y}"), F.lit(0)).cast("bigint")
        cols += [F.col(f"returns_{y}"), s.alias(f"sales_{y}"),
                 return_rate(F.col(f"returns_{y}"), s, "half_up").alias(f"return_rate_{y}")]
    return SearchResult(matched, j.select(*cols), years, fold_case)


def _product_order(products: DataFrame, years) -> DataFrame:
    """Most returns in the last year first, then by ASIN."""
    return products.orderBy(F.desc(f"returns_{years[-1]}"), F.asc("asin")) if years else products


def return_reasons(matched: DataFrame, years, fold_case: bool = True) -> DataFrame:
    """(asin, return_reason, count_<y>...) ordered by asin, last year's count
    descending, reason."""
    r = keyed_sums(matched, ["asin", "return_reason"], _year_sums(years, prefix="count"), fold_case)
    order = [F.asc("asin_key")]
    if years:
        order.append(F.desc(f"count_{years[-1]}"))
    counts = [F.col(f"count_{y}").cast("bigint").alias(f"count_{y}") for y in years]
    return (r.select("asin", "return_reason", *counts, "asin_key", "return_reason_key")
            .orderBy(*order, F.asc("return_reason_key")).drop("asin_key", "return_reason_key"))


def nest_reasons(products: DataFrame, reasons: DataFrame, years, fold_case: bool = True) -> DataFrame:
    """products + ``return_reasons``: array<struct<reason, count_<y>...>>,
    most frequent (last year) first, ties by reason; ``[]`` when none. The
    ASIN match is null-safe (a NULL ASIN keeps its reasons)."""
    last = f"count_{years[-1]}" if years else None
    entry = F.struct(*([(-F.col(last)).alias("_k")] if last else []),
                     F.col("return_reason").alias("reason"),
                     *[F.col(f"count_{y}") for y in years])
    nested = (reasons.groupBy(key_of(reasons, "asin", fold_case).alias("_asin"))
              .agg(F.sort_array(F.collect_list(entry)).alias("_r")))
    drop_key = F.transform("_r", lambda e: F.struct(
        e["reason"].alias("reason"), *[e[f"count_{y}"].alias(f"count_{y}") for y in years]))
    nested = nested.select("_asin", drop_key.alias("return_reasons"))
    j = products.join(nested, key_of(products, "asin", fold_case).eqNullSafe(nested["_asin"]), "left")
    empty = F.array().cast(nested.schema["return_reasons"].dataType)
    return j.drop("_asin").withColumn("return_reasons", F.coalesce("return_reasons", empty))


def search_summary(products: DataFrame, years) -> DataFrame:
    """One row: product_count, total_returns_<y>, total_sales_<y>,
    return_rate_<y> (half-even, 0 without sales). Zeros when nothing
    matched. (The source's page shows it when more than one product matched.)"""
    aggs = [F.count(F.lit(1)).alias("product_count")]
    for y in years:
        aggs += [F.coalesce(F.sum(f"returns_{y}"), F.lit(0)).cast("bigint").alias(f"total_returns_{y}"),
                 F.coalesce(F.sum(f"sales_{y}"), F.lit(0)).cast("bigint").alias(f"total_sales_{y}")]
    t = products.agg(*aggs)
    rates = [return_rate(F.col(f"total_returns_{y}"), F.col(f"total_sales_{y}"), "half_even",
                         zero_when_no_sales=True).alias(f"return_rate_{y}") for y in years]
    return t.select("*", *rates)


def combined_reasons(matched: DataFrame, years, fold_case: bool = True) -> DataFrame:
    """(return_reason, count_<y>...) over all matched products; a reason
    with zero in every year still appears."""
    r = keyed_sums(matched, ["return_reason"], _year_sums(years, prefix="count"), fold_case)
    order = [F.desc(f"count_{years[-1]}")] if years else []
    counts = [F.col(f"count_{y}").cast("bigint").alias(f"count_{y}") for y in years]
    return (r.select("return_reason", *counts, "return_reason_key")
            .orderBy(*order, F.asc("return_reason_key")).drop("return_reason_key"))


def with_rate_bands(products: DataFrame, years) -> DataFrame:
    """Adds rate_band_<y> (danger/warning/none) and has_returns_<y>."""
    extra = []
    for y in years:
        extra += [rate_band(F.col(f"return_rate_{y}")).alias(f"rate_band_{y}"),
                  has_returns(F.col(f"returns_{y}")).alias(f"has_returns_{y}")]
    return products.select("*", *extra)
