"""rmalytics: marketplace returns analytics as Spark DataFrame operators.

Report files (returns, all-orders) are ingested into Parquet tables
partitioned by ``year``; every report question is a lazy DataFrame built
from Spark SQL expressions, so Catalyst prunes, pushes down and plans it.
"""

from rmalytics.operators.export import export_returns
from rmalytics.operators.freshness import freshness
from rmalytics.operators.ingest import prepare_returns, prepare_sales
from rmalytics.operators.monthly import (
    monthly_pivot,
    returns_by_year_month,
    year_series,
    yearly_total,
)
from rmalytics.operators.search import search_products
from rmalytics.operators.suggest import suggest_skus
from rmalytics.operators.top_returned import top_returned
from rmalytics.sources.csv_sink import write_export_csv
from rmalytics.sources.reports import (
    ingest_returns,
    ingest_sales,
    load_returns_report,
    load_sales_report,
)
from rmalytics.sources.tables import append_table, read_returns, read_sales

__all__ = [
    "append_table",
    "export_returns",
    "freshness",
    "ingest_returns",
    "ingest_sales",
    "load_returns_report",
    "load_sales_report",
    "monthly_pivot",
    "prepare_returns",
    "prepare_sales",
    "read_returns",
    "read_sales",
    "returns_by_year_month",
    "search_products",
    "suggest_skus",
    "top_returned",
    "write_export_csv",
    "year_series",
    "yearly_total",
]
