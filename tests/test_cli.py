"""The command line over a small warehouse built from report files."""

import io
import json
import os

from tests.test_ingest import returns_row, sales_row, write_returns, write_sales

from rmalytics.cli import main


def run(spark, *argv):
    buf = io.StringIO()
    assert main(list(argv), spark=spark, out=buf) == 0
    return buf.getvalue()


def test_cli_screens(spark, tmp_path):
    wh = str(tmp_path / "wh")
    r = write_returns(str(tmp_path / "r.tsv"), [
        returns_row("5-Jan-24", "2", **{"ASIN": "A1", "Merchant SKU": "S1"}),
        returns_row("5-Mar-24", "3", **{"ASIN": "A1", "Merchant SKU": "S2", "Return Reason": "Defective"}),
        returns_row("5/Mar/24", "1")])
    s = write_sales(str(tmp_path / "s.tsv"), [sales_row(**{"asin": "A1", "quantity": "4",
                                                           "purchase-date": "2024-03-01T10:00:00Z"})])
    out = run(spark, "load", "returns", r, "--warehouse", wh, "--on-error", "quarantine")
    assert "bad Return request date\t1" in out
    assert spark.read.parquet(f"{wh}/returns_rejected").count() == 1
    run(spark, "load", "sales", s, "--warehouse", wh)

    run(spark, "load", "returns", r, "--warehouse", wh + "2", "--on-error", "quarantine")
    run(spark, "load", "returns", r, "--warehouse", wh + "2", "--on-error", "quarantine")
    assert "1 folded load" in run(spark, "compact", "returns", "--warehouse", wh + "2")
    assert spark.read.parquet(f"{wh}2/returns").count() == 4

    dash = run(spark, "dashboard", "--warehouse", wh, "--year", "2024", "--series-year", "2025")
    assert "== top returned SKUs 2024" in dash and "75.00%" in dash
    assert "== series 2025" in dash

    lines = [json.loads(x) for x in run(spark, "products", "s", "--warehouse", wh,
                                        "--years", "2024", "--json").splitlines()]
    summary = lines[0]
    assert summary["total_returns_2024"] == 2 and summary["total_sales_2024"] == 4
    product = next(x for x in lines if x.get("merchant_skus") == "S1,S2")
    assert product["return_rate_2024"] == 50.0 and product["rate_band_2024"] == "danger"

    out_dir = str(tmp_path / "export")
    run(spark, "export", "--warehouse", wh, "--start", "2024-01-01", "--end", "2024-12-31", "--out", out_dir)
    text = "".join(open(os.path.join(out_dir, f), encoding="utf-8").read()
                   for f in os.listdir(out_dir) if f.startswith("part-"))
    assert "A1,S2,3" in text

    sug = run(spark, "suggest", "s", "--warehouse", wh, "--json")
    assert [json.loads(x)["merchant_sku"] for x in sug.splitlines()] == ["S1", "S2"]
