"""Registered plans: name -> (spark, sf_dir) -> DataFrame, and their oracles.

Parameters are those of the source application's screens, moved to the
driver data's years (1995-2001): dashboard year 1996, search years 1996 and
1997, export range 1996-01-15 .. 1997-06-30.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rmalytics.operators.export import export_returns
from rmalytics.operators.freshness import freshness
from rmalytics.operators.monthly import monthly_pivot, returns_by_year_month, year_series, yearly_total
from rmalytics.operators.search import search_products, with_rate_bands
from rmalytics.operators.suggest import suggest_skus
from rmalytics.operators.top_returned import top_returned
from rmalytics.plans import oracle, roundtrip
from rmalytics.plans.warehouse import tables
from rmalytics.functions.keys import without_stored_keys
from rmalytics.functions.display import count_text, pct_text, product_link
from rmalytics.sources.json_out import series_json

TOP_YEAR = 1996
TOP_N = 50
SEARCH_TERM = "ring"
SEARCH_YEARS = (1996, 1997)
GAP_TERM = "b"  # every ASIN; a blank SKU has no term of its own
WILDCARD_TERM = "r_ng-1"
LITERAL_TERM = "-1"
SERIES_YEARS = (1996, 2025)
YEARS_WITH_GAP = (1996, 2025)  # no sales and no returns in the second
EXPORT_START, EXPORT_END = "1996-01-15", "1997-06-30"
SUGGEST_TERM, SUGGEST_N = "ring", 10
LINK_BASE = "https://marketplace.example/dp/"


def q_top_returned_skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = tables(spark, sf_dir)
    return top_returned(r, s, TOP_YEAR, TOP_N)


def q_returns_by_year_month(spark, sf_dir):
    r, _ = tables(spark, sf_dir)
    return returns_by_year_month(r)


def q_monthly_pivot(spark, sf_dir):
    r, _ = tables(spark, sf_dir)
    return monthly_pivot(r)


def q_yearly_total(spark, sf_dir):
    r, _ = tables(spark, sf_dir)
    return yearly_total(r)


def q_year_series_zero_fill(spark, sf_dir):
    r, _ = tables(spark, sf_dir)
    return year_series(spark, r, list(SERIES_YEARS))


def _search(spark, sf_dir, term=SEARCH_TERM, literal=False):
    r, s = tables(spark, sf_dir)
    return search_products(r, s, term, SEARCH_YEARS, literal=literal)


def q_product_search(spark, sf_dir):
    return _search(spark, sf_dir).products


def q_product_search_wildcard(spark, sf_dir):
    return _search(spark, sf_dir, WILDCARD_TERM).products


def q_product_search_literal(spark, sf_dir):
    return _search(spark, sf_dir, LITERAL_TERM, literal=True).products


def q_product_search_year_without_sales(spark, sf_dir):
    r, s = tables(spark, sf_dir)
    return search_products(r, s, SEARCH_TERM, YEARS_WITH_GAP).products


def q_return_reasons(spark, sf_dir):
    return _search(spark, sf_dir).reasons


def q_products_with_nested_reasons(spark, sf_dir):
    p = _search(spark, sf_dir).products_with_reasons()
    return p.withColumn("return_reasons_json", F.to_json("return_reasons")).drop("return_reasons")


def q_search_summary(spark, sf_dir):
    return _search(spark, sf_dir).summary


def q_combined_reasons(spark, sf_dir):
    return _search(spark, sf_dir).combined_reasons


def q_rate_bands(spark, sf_dir):
    return with_rate_bands(_search(spark, sf_dir).products, SEARCH_YEARS)


def q_export_range(spark, sf_dir):
    r, _ = tables(spark, sf_dir)
    return export_returns(r, EXPORT_START, EXPORT_END)


def q_suggest_skus(spark, sf_dir):
    r, _ = tables(spark, sf_dir)
    return suggest_skus(r, SUGGEST_TERM, SUGGEST_N)


def q_freshness(spark, sf_dir):
    r, _ = tables(spark, sf_dir)
    return freshness(r)


def q_display_format(spark, sf_dir):
    t = q_top_returned_skus(spark, sf_dir)
    return t.select("asin", "merchant_sku",
                    count_text(F.col("total_returns")).alias("total_returns_text"),
                    F.coalesce(count_text(F.col("total_sold")), F.lit("")).alias("total_sold_text"),
                    pct_text(F.col("return_pct")).alias("return_pct_text"),
                    product_link(F.col("asin"), LINK_BASE).alias("product_link"))


def q_monthly_series_json(spark, sf_dir):
    r, _ = tables(spark, sf_dir)
    return series_json(monthly_pivot(r))


def mixed_case_returns(returns: DataFrame) -> DataFrame:
    """Returns whose spelling varies by row: quantities divisible by 5 show
    the SKU with e-acute for 'e', other odd quantities in upper case;
    quantities divisible by 3 show the ASIN in lower case."""
    q = F.col("return_quantity")
    sku = F.col("merchant_sku")
    return without_stored_keys(returns).withColumns({
        "merchant_sku": F.when(q % 5 == 0, F.translate(sku, "e", chr(0xE9)))
                         .when(q % 2 == 1, F.upper(sku)).otherwise(sku),
        "asin": F.when(q % 3 == 0, F.lower("asin")).otherwise(F.col("asin")),
    })


def returns_with_gaps(returns: DataFrame) -> DataFrame:
    """Returns of which some have an unknown month (quantities divisible by
    7), no ASIN (by 11) or a blank SKU (by 13)."""
    q = F.col("return_quantity")
    return without_stored_keys(returns).withColumns({
        "month": F.when(q % 7 == 0, "Smarch").otherwise(F.col("month")),
        "month_no": F.when(q % 7 != 0, F.col("month_no")),
        "asin": F.when(q % 11 != 0, F.col("asin")),
        "merchant_sku": F.when(q % 13 == 0, "").otherwise(F.col("merchant_sku")),
    })


def padded_returns(returns: DataFrame) -> DataFrame:
    """Returns whose SKUs have spaces or a tab around them."""
    q, sku = F.col("return_quantity"), F.col("merchant_sku")
    return without_stored_keys(returns).withColumn("merchant_sku", F.when(q % 2 == 0, F.concat(F.lit("  "), sku, F.lit(" ")))
                              .when(q % 3 == 0, F.concat(F.lit("\t"), sku)).otherwise(sku))


def q_returns_by_year_month_gaps(spark, sf_dir):
    return returns_by_year_month(returns_with_gaps(tables(spark, sf_dir)[0]))


def q_monthly_pivot_gaps(spark, sf_dir):
    return monthly_pivot(returns_with_gaps(tables(spark, sf_dir)[0]))


def q_nested_reasons_gaps(spark, sf_dir):
    r, s = tables(spark, sf_dir)
    p = search_products(returns_with_gaps(r), s, GAP_TERM, SEARCH_YEARS).products_with_reasons()
    return p.withColumn("return_reasons_json", F.to_json("return_reasons")).drop("return_reasons")


def q_export_range_gaps(spark, sf_dir):
    return export_returns(returns_with_gaps(tables(spark, sf_dir)[0]), EXPORT_START, EXPORT_END)


def q_export_padded_roundtrip(spark, sf_dir):
    r = padded_returns(tables(spark, sf_dir)[0])
    return roundtrip.export_csv_roundtrip(spark, r, EXPORT_START, EXPORT_END)


def q_top_returned_mixed_case(spark, sf_dir):
    r, s = tables(spark, sf_dir)
    return top_returned(mixed_case_returns(r), s, TOP_YEAR, TOP_N)


def q_product_search_mixed_case(spark, sf_dir):
    r, s = tables(spark, sf_dir)
    return search_products(mixed_case_returns(r), s, SEARCH_TERM.upper(), SEARCH_YEARS).products


def q_export_mixed_case(spark, sf_dir):
    r, _ = tables(spark, sf_dir)
    return export_returns(mixed_case_returns(r), EXPORT_START, EXPORT_END)


def q_export_csv_roundtrip(spark, sf_dir):
    return roundtrip.export_csv_roundtrip(spark, tables(spark, sf_dir)[0], EXPORT_START, EXPORT_END)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "top_returned_skus": q_top_returned_skus,
    "returns_by_year_month": q_returns_by_year_month,
    "monthly_pivot": q_monthly_pivot,
    "yearly_total": q_yearly_total,
    "year_series_zero_fill": q_year_series_zero_fill,
    "product_search": q_product_search,
    "product_search_wildcard": q_product_search_wildcard,
    "product_search_literal": q_product_search_literal,
    "product_search_year_without_sales": q_product_search_year_without_sales,
    "return_reasons": q_return_reasons,
    "products_with_nested_reasons": q_products_with_nested_reasons,
    "search_summary": q_search_summary,
    "combined_reasons": q_combined_reasons,
    "rate_bands": q_rate_bands,
    "export_range": q_export_range,
    "suggest_skus": q_suggest_skus,
    "freshness": q_freshness,
    "display_format": q_display_format,
    "top_returned_mixed_case": q_top_returned_mixed_case,
    "product_search_mixed_case": q_product_search_mixed_case,
    "export_mixed_case": q_export_mixed_case,
    "monthly_series_json": q_monthly_series_json,
    "export_csv_roundtrip": q_export_csv_roundtrip,
    "returns_by_year_month_gaps": q_returns_by_year_month_gaps,
    "monthly_pivot_gaps": q_monthly_pivot_gaps,
    "nested_reasons_gaps": q_nested_reasons_gaps,
    "export_range_gaps": q_export_range_gaps,
    "export_padded_roundtrip": q_export_padded_roundtrip,
    "ingest_returns_roundtrip": roundtrip.ingest_returns_roundtrip,
    "ingest_returns_quarantine": roundtrip.ingest_returns_quarantine,
    "ingest_sales_roundtrip": roundtrip.ingest_sales_roundtrip,
    "stream_returns_roundtrip": roundtrip.stream_returns_roundtrip,
}

ORACLE: dict[str, str] = {
    "top_returned_skus": oracle.top_returned(TOP_YEAR, TOP_N),
    "returns_by_year_month": oracle.returns_by_year_month(),
    "monthly_pivot": oracle.monthly_pivot(),
    "yearly_total": oracle.yearly_total(),
    "year_series_zero_fill": oracle.year_series(SERIES_YEARS),
    "product_search": oracle.product_search(SEARCH_TERM, SEARCH_YEARS),
    "product_search_wildcard": oracle.product_search(WILDCARD_TERM, SEARCH_YEARS),
    "product_search_literal": oracle.product_search(LITERAL_TERM, SEARCH_YEARS, literal=True),
    "product_search_year_without_sales": oracle.product_search(SEARCH_TERM, YEARS_WITH_GAP),
    "return_reasons": oracle.return_reasons(SEARCH_TERM, SEARCH_YEARS),
    "products_with_nested_reasons": oracle.nested_reasons_json(SEARCH_TERM, SEARCH_YEARS),
    "search_summary": oracle.search_summary(SEARCH_TERM, SEARCH_YEARS),
    "combined_reasons": oracle.combined_reasons(SEARCH_TERM, SEARCH_YEARS),
    "rate_bands": oracle.rate_bands(SEARCH_TERM, SEARCH_YEARS),
    "export_range": oracle.export_range(EXPORT_START, EXPORT_END),
    "suggest_skus": oracle.suggest_skus(SUGGEST_TERM, SUGGEST_N),
    "freshness": oracle.freshness(),
    "display_format": oracle.display_format(TOP_YEAR, TOP_N, LINK_BASE),
    "top_returned_mixed_case": oracle.mixed_case(oracle.top_returned(TOP_YEAR, TOP_N)),
    "product_search_mixed_case": oracle.mixed_case(oracle.product_search(SEARCH_TERM.upper(), SEARCH_YEARS)),
    "export_mixed_case": oracle.mixed_case(oracle.export_range(EXPORT_START, EXPORT_END)),
    "monthly_series_json": oracle.monthly_series_json(),
    "export_csv_roundtrip": oracle.export_range(EXPORT_START, EXPORT_END),
    "returns_by_year_month_gaps": oracle.with_gaps(oracle.returns_by_year_month()),
    "monthly_pivot_gaps": oracle.with_gaps(oracle.monthly_pivot()),
    "nested_reasons_gaps": oracle.with_gaps(oracle.nested_reasons_json(GAP_TERM, SEARCH_YEARS)),
    "export_range_gaps": oracle.with_gaps(oracle.export_range(EXPORT_START, EXPORT_END)),
    "export_padded_roundtrip": oracle.padded(oracle.export_range(EXPORT_START, EXPORT_END)),
    "ingest_returns_roundtrip": oracle.ingest_returns_roundtrip(),
    "ingest_returns_quarantine": oracle.ingest_returns_quarantine(),
    "ingest_sales_roundtrip": oracle.ingest_sales_roundtrip(),
    "stream_returns_roundtrip": oracle.ingest_returns_roundtrip(),
}
