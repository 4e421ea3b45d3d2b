"""Ingest and export roundtrips over the driver's tables.

Each plan writes files into a new folder under the shared scratch folder,
loads them through the public ingest/export path and summarises what was
loaded, so that the summary can be compared with SQL over the source rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rmalytics.operators.export import export_returns
from rmalytics.plans import render
from rmalytics.schemas import RETURNS_HEADERS, SALES_FLOAT_HEADERS, SALES_HEADERS, SALES_RENAME, snake
from rmalytics.session import scratch_path
from rmalytics.sources.csv_sink import read_export_csv, write_export_csv
from rmalytics.sources.reports import ingest_returns, ingest_sales
from rmalytics.sources.tables import read_returns, read_sales


def ingest_returns_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "returns-load")
    source = render.rendered(spark, sf_dir, "returns")
    start = _now(spark)
    ingest_returns(spark, source, f"{base}/table")
    return _returns_summary(read_returns(spark, f"{base}/table"), start, _now(spark))


def _now(spark: SparkSession):
    return spark.sql("SELECT localtimestamp() AS t").first().t


def _all_of(checks) -> F.Column:
    """1 where every check holds, else 0."""
    return F.when(reduce(and_, checks), 1).otherwise(0)


def _returns_summary(t: DataFrame, start, end) -> DataFrame:
    mapped = [F.col(snake(h)) == render.filler(h, F.col("order_id")) for h in RETURNS_HEADERS
              if h not in render.RETURNS_FILLED]
    return t.groupBy("year", "month").agg(
        F.sum("return_quantity").cast("bigint").alias("return_units"),
        F.count(F.lit(1)).alias("return_lines"),
        F.sum(F.when(F.col("return_reason") == "", 1).otherwise(0)).cast("bigint").alias("blank_reasons"),
        F.sum(F.length("item_name")).cast("bigint").alias("name_chars"),
        F.sum(_all_of(mapped)).cast("bigint").alias("mapped_lines"),
        F.sum(_all_of([F.col("last_updated").between(F.lit(start), F.lit(end))])).cast("bigint").alias("stamped_lines"),
    )


def ingest_returns_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a slash date or a non-integer quantity are split off; both
    written tables are read back."""
    base = scratch_path(spark, "returns-quarantine")
    src = render.rendered(spark, sf_dir, "returns_with_bad_rows")
    bad = ingest_returns(spark, src, f"{base}/table", on_error="quarantine")
    good = read_returns(spark, f"{base}/table")
    g = good.select(F.lit("loaded").alias("status"), F.lit("").alias("error"))
    b = bad.select(F.lit("rejected").alias("status"), F.array_join("_errors", "; ").alias("error"))
    return g.unionByName(b).groupBy("status", "error").agg(F.count(F.lit(1)).alias("rows"))


def ingest_sales_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "sales-load")
    source = render.rendered(spark, sf_dir, "sales")
    start = _now(spark)
    ingest_sales(spark, source, f"{base}/table")
    t, end = read_sales(spark, f"{base}/table"), _now(spark)
    mapped = [F.col(SALES_RENAME[h]) == render.filler(h, F.col("amazon_order_id")) for h in SALES_HEADERS
              if h not in render.SALES_FILLED]
    line = F.col("merchant_order_id").cast("int")
    mapped += [F.col(SALES_RENAME[h]) == (line * 10 + k).cast("float") for k, h in enumerate(SALES_FLOAT_HEADERS)
               if h != "item-price"]
    mapped.append(F.col("signature_confirmation_recommended") == (line % 3 == 0))
    return t.groupBy("year", "month").agg(
        F.sum("quantity").cast("bigint").alias("units"),
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.when(F.col("item_price") == 0, 1).otherwise(0)).cast("bigint").alias("zero_prices"),
        F.sum(F.when(F.col("item_price").isNull(), 1).otherwise(0)).cast("bigint").alias("null_prices"),
        F.sum(F.col("is_business_order").cast("int")).cast("bigint").alias("business_lines"),
        F.sum(_all_of(mapped)).cast("bigint").alias("mapped_lines"),
        F.sum(_all_of([F.col("last_updated").between(F.lit(start), F.lit(end))])).cast("bigint").alias("stamped_lines"),
    )


def export_csv_roundtrip(spark: SparkSession, returns: DataFrame, start, end) -> DataFrame:
    path = write_export_csv(export_returns(returns, start, end), scratch_path(spark, "export"))
    back = read_export_csv(spark, path)
    return back.select("asin", "merchant_sku", F.col("return_quantity").cast("bigint").alias("return_quantity"))


def stream_returns_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The returns report dropped into a landing folder and loaded by the
    file stream (one availableNow run); summarised like the batch load."""
    from rmalytics.streaming import report_stream

    base = scratch_path(spark, "returns-stream")
    landing = render.rendered(spark, sf_dir, "returns")
    start = _now(spark)
    q = report_stream(spark, landing, f"{base}/table", "returns",
                      checkpoint_dir=f"{base}/checkpoint", on_error="fail",
                      file_glob="*.csv*", available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"stream failed: {q.exception()}")
    return _returns_summary(read_returns(spark, f"{base}/table"), start, _now(spark))
