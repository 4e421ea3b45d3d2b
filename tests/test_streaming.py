"""Landing-folder stream: files dropped over time are loaded once each."""

import os

from pyspark.sql import functions as F

from rmalytics.sources.tables import read_returns
from rmalytics.streaming import report_stream
from tests.test_ingest import returns_row, write_returns


def run_once(spark, landing, table, ckpt):
    q = report_stream(spark, landing, table, "returns", checkpoint_dir=ckpt, available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None


def test_stream_loads_each_file_once(spark, tmp_path):
    landing, table, ckpt = (str(tmp_path / x) for x in ("landing", "table", "ckpt"))
    os.makedirs(landing)
    write_returns(f"{landing}/jan.tsv", [returns_row("5-Jan-24", "2"), returns_row("6-Jan-24", "x")])
    run_once(spark, landing, table, ckpt)
    t = read_returns(spark, table)
    assert t.agg(F.sum("return_quantity")).collect()[0][0] == 2
    assert "load_id" in t.columns
    rejected = spark.read.parquet(table + "_rejected").collect()
    assert len(rejected) == 1 and rejected[0]["_errors"] == "bad Return quantity"

    # a new file arrives; the old one is not loaded again
    write_returns(f"{landing}/feb.tsv", [returns_row("5-Feb-24", "3")])
    run_once(spark, landing, table, ckpt)
    rows = {(r.month, r.return_quantity) for r in read_returns(spark, table).collect()}
    assert rows == {("January", 2), ("February", 3)}

    # nothing new: a rerun changes nothing
    run_once(spark, landing, table, ckpt)
    assert read_returns(spark, table).count() == 2


def test_stream_sales_reports(spark, tmp_path):
    from rmalytics.sources.tables import read_sales
    from tests.test_ingest import sales_row, write_sales

    landing, table = str(tmp_path / "landing"), str(tmp_path / "sales")
    os.makedirs(landing)
    write_sales(f"{landing}/orders.txt", [sales_row(), sales_row(**{"quantity": "5"})])
    q = report_stream(spark, landing, table, "sales", available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None
    t = read_sales(spark, table)
    assert sorted(r.quantity for r in t.collect()) == [2, 5]
    assert os.path.isdir(table + "_checkpoint")


def test_stream_fail_policy_stops_without_writing(spark, tmp_path):
    landing, table = str(tmp_path / "landing"), str(tmp_path / "table")
    os.makedirs(landing)
    write_returns(f"{landing}/bad.tsv", [returns_row("5-Jan-24", "2"), returns_row("5/Jan/24", "1")])
    q = report_stream(spark, landing, table, "returns", on_error="fail", available_now=True)
    try:
        q.awaitTermination(120)
    except Exception:  # noqa: BLE001 - the query is expected to fail
        pass
    assert q.exception() is not None
    files = [f for _, _, fs in os.walk(table) for f in fs if f.endswith(".parquet")]
    assert files == []


def test_a_file_with_other_columns_does_not_hold_up_the_stream(spark, tmp_path):
    from rmalytics.schemas import RETURNS_HEADERS

    landing, table, ckpt = (str(tmp_path / x) for x in ("landing", "table", "ckpt"))
    os.makedirs(landing)
    write_returns(f"{landing}/a.tsv", [returns_row("5-Jan-24", "2")])
    write_returns(f"{landing}/b.tsv", [returns_row("5-Feb-24", "3")], header=list(reversed(RETURNS_HEADERS)))
    write_returns(f"{landing}/c.tsv", [returns_row("5-Mar-24", "4")], header=RETURNS_HEADERS[:-1])
    run_once(spark, landing, table, ckpt)
    assert sorted(r.month for r in read_returns(spark, table).collect()) == ["February", "January"]
    rejected = spark.read.parquet(table + "_rejected").collect()
    assert len(rejected) == 1 and "missing columns" in rejected[0]["_errors"] and rejected[0]["_file"].endswith("c.tsv")
