"""Loads at size: what tasks hold and folders keep doesn't grow with the tables."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rmalytics.functions.numbers import blank_to_zero_float, strict_int
from rmalytics.plans import render, roundtrip
from rmalytics.sources import driver
from rmalytics.sources.reports import ingest_returns, read_report
from rmalytics.sources.tables import read_returns
from tests.test_ingest import returns_row, write_returns


@pytest.fixture
def lines(spark, tmp_path):
    """200 line items of 50 orders, with their orders and parts."""
    n = spark.range(200).select(
        (F.col("id") % 50).alias("l_orderkey"), (F.col("id") % 9).alias("l_partkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"),
        F.lit(3.0).cast("decimal(15,2)").alias("l_quantity"), F.col("id").cast("decimal(15,2)").alias("l_extendedprice"),
        F.expr("date_add(DATE'1996-01-01', cast(id as int))").alias("l_shipdate"), F.lit("F").alias("l_linestatus"),
        F.when(F.col("id") % 2 == 0, "R").otherwise("N").alias("l_returnflag"))
    n.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50).select(F.col("id").alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"),
                           F.lit("1996-01-01").cast("date").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(9).select(F.col("id").alias("p_partkey"), F.lit("a ring").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_reports_are_packed_files_of_bounded_rows(spark, lines, monkeypatch):
    monkeypatch.setattr(render, "ROWS_PER_FILE", 7)
    path = render.rendered(spark, lines, "sales")
    files = glob.glob(f"{path.removeprefix('file:')}/part-*")
    assert all(f.endswith(".csv.gz") for f in files) and len(files) >= 200 / 7
    r = read_report(spark, path)
    assert max(x["count"] for x in r.groupBy("_file").count().collect()) <= 7 and r.count() == 200
    t = roundtrip.ingest_sales_roundtrip(spark, lines)
    assert t.agg(F.sum("lines"), F.sum("mapped_lines"), F.sum("stamped_lines")).first()[:] == (200, 200, 200)
    s = roundtrip.stream_returns_roundtrip(spark, lines)
    assert s.agg(F.sum("return_lines"), F.sum("mapped_lines")).first()[:] == (100, 100)


def test_reports_are_made_behind_their_shuffle(spark, lines):
    plan = render.sales_report(spark, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("amazon-order-id") < plan.index("RepartitionByExpression")
    assert "amazon-order-id" not in plan[plan.index("RepartitionByExpression"):]


def test_packed_files_share_a_task_only_up_to_their_unpacked_size(spark, lines):
    path = render.rendered(spark, lines, "returns")
    n = len(glob.glob(f"{path.removeprefix('file:')}/part-*"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        assert read_report(spark, path).rdd.getNumPartitions() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quarantine_keeps_no_copy_of_the_load(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "persist", lambda *_: pytest.fail("rows are kept"))
    p = write_returns(str(tmp_path / "r.tsv"), [returns_row(), returns_row("5/Jan/24", "2"), returns_row("6-Jan-24", "x")])
    bad = ingest_returns(spark, p, str(tmp_path / "table"), on_error="quarantine")
    assert bad.count() == 2 and read_returns(spark, str(tmp_path / "table")).count() == 1


def test_tables_are_written_small(spark, tmp_path):
    p = write_returns(str(tmp_path / "r.tsv"), [returns_row()])
    ingest_returns(spark, p, str(tmp_path / "table"))
    f, = glob.glob(f"{tmp_path}/table/year=*/load_id=*/*.parquet")
    assert pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD"


@pytest.mark.parametrize("text, number, whole", [("12", 12.0, 12), ("0012.50", 12.5, None), ("12\n", 12.0, 12), ("1e2", 100.0, None), (" 7 ", 7.0, 7),
                                                 ("1_0", 10.0, 10), ("", 0.0, None), (None, 0.0, None), ("x", None, None), ("9999999999", 1e10, None), ("1.", 1.0, None)])
def test_short_ways_give_the_same_numbers(spark, text, number, whole):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(blank_to_zero_float(F.col("c")), strict_int(F.col("c"))).first()[:] == (number, whole)


def test_loads_join_and_sort_a_bounded_number_of_lines_in_a_task(spark, lines, monkeypatch):
    before = [sorted(map(tuple, v(spark, lines).collect())) for v in (driver.returns_view, driver.sales_view)]
    monkeypatch.setattr(driver, "ROWS_PER_TASK", 10)
    for view, rows in zip((driver.returns_view, driver.sales_view), before, strict=True):
        df = view(spark, lines)
        assert df.rdd.getNumPartitions() == 20 and sorted(map(tuple, df.collect())) == rows
