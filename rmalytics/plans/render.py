"""Render the driver's line items as marketplace report files (TSV).

Used by the ingest roundtrip plans: the rendered files go through the same
scan, header check, typed projection and append as an uploaded report. The
renderings vary on purpose (per line number) to exercise the parsing rules:

returns report
  request date: even line -> 'd-MMM-yy' (two-digit year), odd -> 'dd-MMM-yyyy';
                line % 3 == 0 upper-case month; line % 5 == 0 padded with blanks
  quantities:   line % 4 == 0 padded with blanks
  item name:    line == 3 holds a quote, a tab, a newline and an e-acute
  reason:       line == 7 blank; else l_linestatus
  columns:      written in reverse order, plus one extra column
  other text:   '<header>:<order id>', so that no two columns can be mixed up
sales report
  purchase date: l_shipdate at 00:30 wall clock; offset by line % 3:
                 '+09:00', 'Z', '-0500'
  item-price:   line == 1 blank, line == 2 a no-break space, line == 7 '12.5x'
  is-business-order: even line 'TRUE', odd 'false', line == 5 'yes'
  other floats: 10 * line + the column's place among the floats; merchant-order-id holds the line
  signature-confirmation-recommended: line % 3 == 0 'True', else 'no'
  other text:   '<header>:<order id>'
  header names: ' asin ' and 'quantity ' padded
"""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rmalytics.schemas import RETURNS_HEADERS, SALES_FLOAT_HEADERS, SALES_HEADERS
from rmalytics.session import SCRATCH, scratch_path
from rmalytics.sources.driver import asin_of

WRITE_OPTIONS = {"sep": "\t", "header": "true", "quote": '"', "escape": '"',
                 "encoding": "ISO-8859-1", "emptyValue": "",
                 "compression": "gzip", "zlib.compress.level": "BEST_SPEED",
                 "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

#: A file holds no more rows, so that reports of any size are read by as many tasks as they need.
ROWS_PER_FILE = 250_000

SPECIAL_NAME_PARTS = ('"', "\t", "\n", "\u00e9")


# Headers that the reports fill by a rule of their own.
RETURNS_FILLED = ("Order ID", "Order date", "Return request date", "ASIN", "Merchant SKU", "Item Name",
                  "Return quantity", "Order quantity", "Return Reason", "Order Amount")
SALES_FILLED = ("amazon-order-id", "purchase-date", "asin", "sku", "quantity", "is-business-order",
                "signature-confirmation-recommended", "merchant-order-id", *SALES_FLOAT_HEADERS)


def filler(header: str, order_id: F.Column) -> F.Column:
    """Text that tells its column and row."""
    return F.concat(F.lit(f"{header}:"), order_id.cast("string"))


_LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate", "l_linestatus")


def _lineitem(spark: SparkSession, sf_dir: str, where: F.Column | None = None) -> DataFrame:
    """Line items, spread over the session's parallelism by a hash of the order
    id: deterministic on a retry, without the sort a round-robin repartition
    needs for that. The reports' columns are made behind this shuffle, which
    carries only those they are made of."""
    li = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    li = (li if where is None else li.filter(where)).select(*_LINE_COLUMNS)
    return li.repartition(spark.sparkContext.defaultParallelism, F.col("l_orderkey"))


def returns_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem(spark, sf_dir, F.col("l_returnflag") == "R")
    ln = F.col("l_linenumber")
    d = F.col("l_shipdate")
    date = F.when(ln % 2 == 0, F.date_format(d, "d-MMM-yy")).otherwise(F.date_format(d, "dd-MMM-yyyy"))
    date = F.when(ln % 3 == 0, F.upper(date)).otherwise(date)
    date = F.when(ln % 5 == 0, F.concat(F.lit(" "), date, F.lit(" "))).otherwise(date)
    qty = F.col("l_quantity").cast("int").cast("string")
    qty = F.when(ln % 4 == 0, F.concat(F.lit(" "), qty, F.lit(" "))).otherwise(qty)
    q, t, nl, e = SPECIAL_NAME_PARTS
    name = F.when(ln == 3, F.concat(F.lit("Item " + q), F.col("l_partkey").cast("string"),
                                    F.lit(q + t + "deluxe" + nl + e + "dition")))
    name = name.otherwise(F.concat(F.lit("Item "), F.col("l_partkey").cast("string")))
    values = {
        "Order ID": F.col("l_orderkey").cast("string"),
        "Order date": F.date_format(d, "yyyy-MM-dd"),
        "Return request date": date,
        "ASIN": asin_of(F.col("l_partkey")),
        "Merchant SKU": F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")),
        "Item Name": name,
        "Return quantity": qty,
        "Order quantity": qty,
        "Return Reason": F.when(ln == 7, F.lit("")).otherwise(F.col("l_linestatus")),
        "Order Amount": F.col("l_extendedprice").cast("string"),
    }
    cols = [values.get(h, filler(h, F.col("l_orderkey"))).alias(h) for h in reversed(RETURNS_HEADERS)]
    return li.select(*cols, F.lit("x").alias("Extra note"))


def sales_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem(spark, sf_dir)
    ln = F.col("l_linenumber")
    wall = F.date_format(F.col("l_shipdate"), "yyyy-MM-dd'T'00:30:00")
    offset = F.when(ln % 3 == 0, "+09:00").when(ln % 3 == 1, "Z").otherwise("-0500")
    price = (F.when(ln == 1, F.lit("")).when(ln == 2, F.lit("\u00a0"))
             .when(ln == 7, F.lit("12.5x")).otherwise(F.col("l_extendedprice").cast("string")))
    business = F.when(ln == 5, "yes").when(ln % 2 == 0, "TRUE").otherwise("false")
    values = {
        "amazon-order-id": F.col("l_orderkey").cast("string"),
        "purchase-date": F.concat(wall, offset),
        "asin": asin_of(F.col("l_partkey")),
        "sku": F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")),
        "quantity": F.col("l_quantity").cast("int").cast("string"),
        "item-price": price,
        "is-business-order": business,
        "signature-confirmation-recommended": F.when(ln % 3 == 0, "True").otherwise("no"),
        "merchant-order-id": ln.cast("string"),
    }
    values |= {h: (ln * 10 + k).cast("string") for k, h in enumerate(SALES_FLOAT_HEADERS) if h not in values}
    header = {"asin": " asin ", "quantity": "quantity "}
    return li.select(*[values.get(h, filler(h, F.col("l_orderkey"))).alias(header.get(h, h)) for h in SALES_HEADERS])


def write_report(df: DataFrame, path: str) -> str:
    """Write as packed report files of ``ROWS_PER_FILE`` rows at most, as a
    seller would upload several monthly files."""
    df.write.options(**WRITE_OPTIONS).option("maxRecordsPerFile", ROWS_PER_FILE).csv(path)
    return path


def returns_report_with_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The returns report with rejectable rows: a slash date when the order
    key is divisible by 7, a quantity of '1.5' when divisible by 11."""
    rep = returns_report(spark, sf_dir)
    order = F.col("`Order ID`").cast("long")
    return rep.withColumns({
        "Return request date": F.when(order % 7 == 0, F.lit("5/Jan/96"))
                                .otherwise(F.col("`Return request date`")),
        "Return quantity": F.when(order % 11 == 0, F.lit("1.5")).otherwise(F.col("`Return quantity`")),
    })


_REPORTS = {
    "returns": returns_report,
    "returns_with_bad_rows": returns_report_with_bad_rows,
    "sales": sales_report,
}
_lock = threading.Lock()
_key_locks: dict[tuple[str, str, str], threading.Lock] = {}
_rendered: dict[tuple[str, str, str], str] = {}


def rendered(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Folder of report files of ``kind`` rendered from ``sf_dir``, written
    once per application (they never change afterwards)."""
    key = (spark.sparkContext.applicationId, SCRATCH.epoch, sf_dir.rstrip("/"), kind)
    with _lock:
        key_lock = _key_locks.setdefault(key, threading.Lock())
    with key_lock:  # one writer per report; different reports in parallel
        if key not in _rendered:
            path = f"{scratch_path(spark, 'report')}/{kind}"
            _rendered[key] = write_report(_REPORTS[kind](spark, sf_dir), path)
        return _rendered[key]


def render_all(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Every report kind, rendered as concurrent jobs."""
    with ThreadPoolExecutor(max_workers=len(_REPORTS)) as pool:
        futures = {k: pool.submit(rendered, spark, sf_dir, k) for k in _REPORTS}
        return {k: f.result() for k, f in futures.items()}
