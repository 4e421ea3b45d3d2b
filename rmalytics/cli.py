"""Command line: the source application's screens as commands.

    python -m rmalytics load returns|sales FILE... --warehouse DIR [--on-error quarantine]
    python -m rmalytics dashboard --warehouse DIR --year 2024 [--series-year 2025] [--top 50]
    python -m rmalytics products TERM --warehouse DIR [--years 2023 2024 2025]
    python -m rmalytics export --warehouse DIR --start 2024-01-15 --end 2024-03-31 --out DIR
    python -m rmalytics suggest TERM --warehouse DIR [--n 10]

The warehouse folder holds the two tables (``returns/``, ``sales/``). Results
are printed as tables, or as JSON lines with ``--json``; rows are streamed
from the executors, never gathered whole on the driver.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rmalytics.functions.display import pct_text
from rmalytics.operators.export import export_returns
from rmalytics.operators.freshness import freshness
from rmalytics.operators.monthly import monthly_pivot, year_series
from rmalytics.operators.search import search_products, with_rate_bands
from rmalytics.operators.suggest import suggest_skus
from rmalytics.operators.top_returned import top_returned
from rmalytics.sources.csv_sink import write_export_csv
from rmalytics.sources.json_out import json_rows
from rmalytics.sources.reports import ingest_returns, ingest_sales
from rmalytics.sources.tables import compact, read_returns, read_sales


def _emit(title: str, df: DataFrame, as_json: bool, out) -> None:
    if as_json:
        for row in json_rows(df).toLocalIterator():
            print(row.json, file=out)
        return
    print(f"== {title}", file=out)
    cols = df.columns
    print("\t".join(cols), file=out)
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row), file=out)


def _tables(spark: SparkSession, warehouse: str):
    w = warehouse.rstrip("/")
    return read_returns(spark, f"{w}/returns"), read_sales(spark, f"{w}/sales")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rmalytics", description=__doc__.split("\n\n")[0])
    sub = p.add_subparsers(dest="cmd", required=True)

    def common(sp):
        sp.add_argument("--warehouse", required=True, help="folder holding returns/ and sales/")
        sp.add_argument("--json", action="store_true", help="print JSON lines")

    sp = sub.add_parser("load", help="load report files (upload)")
    sp.add_argument("kind", choices=["returns", "sales"])
    sp.add_argument("files", nargs="+")
    sp.add_argument("--on-error", choices=["fail", "quarantine"], default="fail")
    sp.add_argument("--rejected", default=None,
                    help="folder for quarantined rows (default: <warehouse>/<kind>_rejected)")
    sp.add_argument("--single-line-records", action="store_true",
                    help="no field spans lines, which saves large files a scan")
    common(sp)

    sp = sub.add_parser("compact", help="fold a table's loads into one folder for each year")
    sp.add_argument("kind", choices=["returns", "sales"])
    common(sp)

    sp = sub.add_parser("dashboard", help="monthly returns, top returned SKUs, freshness")
    sp.add_argument("--year", type=int, required=True)
    sp.add_argument("--series-year", type=int, default=None)
    sp.add_argument("--top", type=int, default=50)
    common(sp)

    sp = sub.add_parser("products", help="product search with return rates and reasons")
    sp.add_argument("term")
    sp.add_argument("--years", type=int, nargs="+", default=[2023, 2024, 2025])
    sp.add_argument("--literal", action="store_true", help="'%%' and '_' match themselves")
    common(sp)

    sp = sub.add_parser("export", help="units returned per SKU in a date range, as CSV")
    sp.add_argument("--start", required=True)
    sp.add_argument("--end", required=True)
    sp.add_argument("--out", required=True)
    common(sp)

    sp = sub.add_parser("suggest", help="SKUs containing a term")
    sp.add_argument("term")
    sp.add_argument("--n", type=int, default=10)
    common(sp)
    return p


def main(argv=None, spark: SparkSession | None = None, out=None) -> int:
    args = _parser().parse_args(argv)
    out = out or sys.stdout
    spark = spark or SparkSession.builder.appName("rmalytics").getOrCreate()
    w = args.warehouse.rstrip("/")

    if args.cmd == "load":
        ingest = ingest_returns if args.kind == "returns" else ingest_sales
        where = args.rejected or f"{w}/{args.kind}_rejected"
        bad = ingest(spark, args.files, f"{w}/{args.kind}", on_error=args.on_error,
                     multiline=not args.single_line_records, rejected_path=where)
        if bad is not None:
            # rejected rows are in a folder of this load; only counts are printed
            counts = (bad.groupBy(F.array_join("_errors", "; ").alias("errors"))
                      .agg(F.count(F.lit(1)).alias("rows")).orderBy("errors"))
            _emit(f"rejected rows in {where}", counts, args.json, out)
        return 0

    if args.cmd == "compact":
        now = compact(spark, f"{w}/{args.kind}")
        print(f"{args.kind}: {len(now.compacted)} folded load, up to micro-batch {now.folded_to}", file=out)
        return 0

    r, s = _tables(spark, w)
    if args.cmd == "dashboard":
        _emit("returns by month", monthly_pivot(r), args.json, out)
        if args.series_year is not None:
            _emit(f"series {args.series_year}", year_series(spark, r, [args.series_year]), args.json, out)
        top = top_returned(r, s, args.year, args.top)
        _emit(f"top returned SKUs {args.year}",
              top.withColumn("return_pct_text", pct_text(F.col("return_pct"))), args.json, out)
        _emit("last updated", freshness(r), args.json, out)
    elif args.cmd == "products":
        res = search_products(r, s, args.term, args.years, literal=args.literal).persist()
        try:
            _emit("summary", res.summary, args.json, out)
            _emit("products", with_rate_bands(res.products, res.years), args.json, out)
            _emit("reasons", res.reasons, args.json, out)
            _emit("combined reasons", res.combined_reasons, args.json, out)
        finally:
            res.unpersist()
    elif args.cmd == "export":
        write_export_csv(export_returns(r, args.start, args.end), args.out)
        print(args.out, file=out)
    elif args.cmd == "suggest":
        _emit("suggestions", suggest_skus(r, args.term, args.n), args.json, out)
    return 0
