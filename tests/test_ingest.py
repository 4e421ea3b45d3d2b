"""Report ingest: scan, header checks, typed projection, load policy, append."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from rmalytics.operators.ingest import ReportRowError
from rmalytics.schemas import RETURNS_HEADERS, SALES_HEADERS
from rmalytics.sources.csv_sink import read_export_csv, write_export_csv
from rmalytics.sources.reports import (
    ReportHeaderError,
    ingest_returns,
    ingest_sales,
    load_returns_report,
    load_sales_report,
)
from rmalytics.sources.tables import read_returns

NBSP = chr(0xA0)
E_ACUTE = chr(0xE9)


def tsv_field(v):
    if any(c in v for c in '\t\n"'):
        return '"' + v.replace('"', '""') + '"'
    return v


def write_tsv(path, header, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="latin-1", newline="") as f:
        f.write("\t".join(tsv_field(h) for h in header) + "\n")
        for r in rows:
            f.write("\t".join(tsv_field(v) for v in r) + "\n")
    return path


def returns_row(date="5-Jan-24", qty="2", **over):
    base = {h: "" for h in RETURNS_HEADERS}
    base.update({"Order ID": "o1", "Return request date": date, "ASIN": "A1", "Merchant SKU": "S1",
                 "Item Name": "thing", "Return quantity": qty, "Order quantity": "1",
                 "Return Reason": "Too small"})
    base.update(over)
    return base


def write_returns(path, rows, header=RETURNS_HEADERS, extra=()):
    cols = list(header) + list(extra)
    return write_tsv(path, cols, [[r.get(c, "x") for c in cols] for r in rows])


def test_returns_dates_quantities_and_text(spark, tmp_path):
    rows = [returns_row("5-Jan-24"), returns_row("05-JAN-2024", " 3 "), returns_row(" 5-jan-24 "),
            returns_row("99-Jan-24", **{"Return Reason": ""}),
            returns_row("1-Feb-2023", **{"Item Name": 'a\tb "q"\nline ' + E_ACUTE})]
    p = write_returns(str(tmp_path / "r.tsv"), rows, extra=["Extra col"])
    df = load_returns_report(spark, p)
    assert "extra_col" not in df.columns and "Extra col" not in df.columns
    got = [(r.month, r.year, r.return_quantity, r.return_reason, r.item_name) for r in df.collect()]
    assert got[0][:3] == ("January", 2024, 2)
    assert got[1][:3] == ("January", 2024, 3)
    assert got[2][:2] == ("January", 2024)
    assert got[3][:2] == ("January", 2024) and got[3][3] == ""
    assert got[4][:2] == ("February", 2023) and got[4][4] == 'a\tb "q"\nline ' + E_ACUTE
    assert df.filter(F.col("month_no") != 1).count() == 1
    assert dict(df.dtypes)["last_updated"] == "timestamp_ntz"


def test_returns_column_order_free(spark, tmp_path):
    p = write_returns(str(tmp_path / "r.tsv"), [returns_row()], header=list(reversed(RETURNS_HEADERS)))
    assert load_returns_report(spark, p).collect()[0].merchant_sku == "S1"


@pytest.mark.parametrize("row", [
    returns_row("5/Jan/24"), returns_row("5-Foo-24"), returns_row(""),
    returns_row(qty=""), returns_row(qty="x"), returns_row(qty="1.5"),
])
def test_returns_bad_row_fails_whole_load(spark, tmp_path, row):
    p = write_returns(str(tmp_path / "r.tsv"), [returns_row(), row])
    table = str(tmp_path / "table")
    with pytest.raises(ReportRowError, match="bad Return"):
        ingest_returns(spark, p, table)
    files = [f for _, _, fs in os.walk(table) for f in fs if f.endswith(".parquet")]
    assert files == []


def test_returns_quarantine(spark, tmp_path):
    p = write_returns(str(tmp_path / "r.tsv"), [returns_row(), returns_row("5/Jan/24", "x")])
    good, bad = load_returns_report(spark, p, on_error="quarantine")
    assert good.count() == 1
    table = str(tmp_path / "table")
    bad2 = ingest_returns(spark, p, table, on_error="quarantine")
    assert read_returns(spark, table).count() == 1 and bad2.count() == 1
    errs = bad.collect()[0]["_errors"]
    assert errs == ["bad Return request date", "bad Return quantity"]


def test_returns_missing_header(spark, tmp_path):
    header = [h for h in RETURNS_HEADERS if h != "Merchant SKU"]
    p = write_returns(str(tmp_path / "r.tsv"), [returns_row()], header=header)
    with pytest.raises(ReportHeaderError, match="Merchant SKU"):
        load_returns_report(spark, p)


def test_same_file_twice_doubles(spark, tmp_path):
    p = write_returns(str(tmp_path / "r.tsv"), [returns_row(), returns_row("1-Mar-24", "4")])
    table = str(tmp_path / "table")
    for _ in range(2):
        assert ingest_returns(spark, p, table) is None
    t = read_returns(spark, table)
    assert t.count() == 4
    assert t.agg(F.sum("return_quantity")).collect()[0][0] == 12
    assert sorted(os.listdir(table))[-1] == "year=2024"


def sales_row(**over):
    base = {h: "" for h in SALES_HEADERS}
    base.update({"amazon-order-id": "o1", "purchase-date": "2024-01-01T00:30:00+09:00",
                 "asin": "A1", "sku": "S1", "quantity": "2", "item-price": "12.5",
                 "is-business-order": "false", "signature-confirmation-recommended": "TRUE"})
    base.update(over)
    return base


def write_sales(path, rows, header=SALES_HEADERS, pad=()):
    names = [f" {h} " if h in pad else h for h in header]
    return write_tsv(path, names, [[r.get(h, "") for h in header] for r in rows])


def test_sales_projection(spark, tmp_path):
    rows = [sales_row(), sales_row(**{"purchase-date": "2024-01-01T00:30:00Z", "item-price": ""}),
            sales_row(**{"purchase-date": "2024-01-31T23:59:59-0800", "item-price": "  "}),
            sales_row(**{"item-price": NBSP, "is-business-order": "TRUE"}),
            sales_row(**{"item-price": "12.5x", "is-business-order": "yes"}),
            sales_row(**{"is-business-order": "true"})]
    p = write_sales(str(tmp_path / "s.tsv"), rows, pad=("asin", "quantity"))
    df = load_sales_report(spark, p)
    got = [(r.month, r.year, r.item_price, r.is_business_order, r.signature_confirmation_recommended)
           for r in df.collect()]
    assert [g[:2] for g in got] == [("January", 2024)] * 6
    assert [g[2] for g in got] == [12.5, 0.0, 0.0, 0.0, None, 12.5]
    assert [g[3] for g in got] == [False, False, False, True, False, True]
    assert all(g[4] for g in got)
    assert dict(df.dtypes)["item_price"] == "float"
    assert dict(df.dtypes)["quantity"] == "int"


def test_sales_snake_case_header_accepted(spark, tmp_path):
    header = [h.replace("-", "_") for h in SALES_HEADERS]
    r = {h.replace("-", "_"): v for h, v in sales_row().items()}
    p = write_tsv(str(tmp_path / "s.tsv"), header, [[r[h] for h in header]])
    assert load_sales_report(spark, p).count() == 1


@pytest.mark.parametrize("date", ["2024-01-01", "2024-01-01T00:30:00", "2024-13-01T00:00:00Z"])
def test_sales_bad_purchase_date(spark, tmp_path, date):
    p = write_sales(str(tmp_path / "s.tsv"), [sales_row(**{"purchase-date": date})])
    with pytest.raises(ReportRowError, match="bad purchase-date"):
        ingest_sales(spark, p, str(tmp_path / "table"))


def test_sales_missing_header(spark, tmp_path):
    header = [h for h in SALES_HEADERS if h != "item-tax"]
    p = write_sales(str(tmp_path / "s.tsv"), [sales_row()], header=header)
    with pytest.raises(ReportHeaderError, match="item-tax"):
        load_sales_report(spark, p)


def test_export_csv_quoting(spark, tmp_path):
    df = spark.createDataFrame([('a,"b', None, 3)], "asin string, merchant_sku string, return_quantity long")
    path = write_export_csv(df, str(tmp_path / "out"))
    text = "".join(open(os.path.join(path, f), encoding="utf-8", newline="").read()
                   for f in sorted(os.listdir(path)) if f.startswith("part-"))
    assert "ASIN,Merchant SKU,Return quantity\r\n" in text
    assert '"a,""b",,3\r\n' in text
    back = read_export_csv(spark, path).collect()
    assert [tuple(x) for x in back] == [('a,"b', None, "3")]


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    write_returns(str(tmp_path / "in" / "a.tsv"), [returns_row("5-Jan-24", "2")])
    write_returns(str(tmp_path / "in" / "b.tsv"), [returns_row("5-Feb-24", "3")],
                  header=list(reversed(RETURNS_HEADERS)), extra=["New column"])
    table = str(tmp_path / "table")
    ingest_returns(spark, str(tmp_path / "in"), table)
    got = sorted((r.month, r.return_quantity, r.merchant_sku) for r in read_returns(spark, table).collect())
    assert got == [("February", 3, "S1"), ("January", 2, "S1")]


def test_a_file_without_required_columns_is_rejected_alone(spark, tmp_path):
    write_returns(str(tmp_path / "in" / "a.tsv"), [returns_row("5-Jan-24", "2"), returns_row("5/Jan/24", "2")])
    write_returns(str(tmp_path / "in" / "b.tsv"), [returns_row("5-Feb-24", "3")],
                  header=[h for h in RETURNS_HEADERS if h != "Merchant SKU"])
    table = str(tmp_path / "table")
    with pytest.raises(ReportHeaderError, match="Merchant SKU"):
        ingest_returns(spark, str(tmp_path / "in"), table)
    bad = ingest_returns(spark, str(tmp_path / "in"), table, on_error="quarantine")
    got = sorted((r._file.rsplit("/", 1)[1], r._errors[0].split(":")[0]) for r in bad.collect())
    assert got == [("a.tsv", "bad Return request date"), ("b.tsv", "returns report is missing columns")]
    assert [r.month for r in read_returns(spark, table).collect()] == ["January"]


def test_rejected_rows_of_each_load_are_its_own(spark, tmp_path):
    p = write_returns(str(tmp_path / "r.tsv"), [returns_row("5-Jan-24", "x"), returns_row("5-Jan-24", "2")])
    table = str(tmp_path / "table")
    assert [ingest_returns(spark, p, table, on_error="quarantine").count() for _ in range(2)] == [1, 1]
    assert spark.read.parquet(table + "_rejected").count() == 2
    assert read_returns(spark, table).count() == 2


def test_a_table_never_loaded_is_empty(spark, tmp_path):
    from rmalytics.operators.suggest import suggest_skus
    from rmalytics.schemas import RETURNS_COLUMNS

    t = read_returns(spark, str(tmp_path / "none"))
    assert t.count() == 0 and set(RETURNS_COLUMNS) <= set(t.columns)
    assert suggest_skus(t, "s").count() == 0


def test_export_keeps_blanks(spark, tmp_path):
    skus = ["  S 1  ", "\tT", "U\t", "V"]
    df = spark.createDataFrame([("A", s, 1) for s in skus], "asin string, merchant_sku string, return_quantity long")
    back = read_export_csv(spark, write_export_csv(df, str(tmp_path / "out"))).collect()
    assert sorted(r.merchant_sku for r in back) == sorted(skus)


def test_rendered_reports_hold_the_padded_values(spark):
    from rmalytics.plans.render import rendered
    from rmalytics.sources.reports import read_report, report_layouts

    sf = "/root/testdata/sf0.001"
    r = read_report(spark, rendered(spark, sf, "returns"))
    padded = lambda c: r.filter(F.col(c) != F.trim(F.col(c))).count()
    assert padded("Return request date") > 0 and padded("Return quantity") > 0
    assert all(" asin " in names and "quantity " in names for names in report_layouts(spark, rendered(spark, sf, "sales")))


def test_several_files_same_header_load_together(spark, tmp_path):
    for i, m in enumerate(("Jan", "Feb", "Mar")):
        write_returns(str(tmp_path / "in" / f"{m}.tsv"), [returns_row(f"5-{m}-24", str(i + 1))])
    table = str(tmp_path / "table")
    ingest_returns(spark, str(tmp_path / "in"), table)
    assert read_returns(spark, table).agg(F.sum("return_quantity")).collect()[0][0] == 6


def test_sales_short_row_counts_missing_fields_as_blank(spark, tmp_path):
    """A row that stops early: its missing prices load as 0.0 (FIXTURES 4; the
    source application fails on it)."""
    full = [sales_row()[h] for h in SALES_HEADERS]
    cut = SALES_HEADERS.index("item-price")
    p = str(tmp_path / "s.tsv")
    with open(p, "w", encoding="latin-1", newline="") as f:
        f.write("\t".join(SALES_HEADERS) + "\n")
        f.write("\t".join(full) + "\n")
        f.write("\t".join(full[:cut]) + "\n")
    rows = load_sales_report(spark, p).collect()
    assert [r.item_price for r in rows] == [12.5, 0.0]
    assert rows[1].is_business_order is False and rows[1].ship_city == ""


def test_crlf_line_endings(spark, tmp_path):
    rows = [returns_row("5-Jan-24", "2", **{"Refunded Amount": "9.99"}),
            returns_row("6-Feb-24", "3", **{"Item Name": "two\r\nlines"})]
    p = str(tmp_path / "crlf.tsv")
    with open(p, "w", encoding="latin-1", newline="") as f:
        w = csv.writer(f, delimiter="\t", lineterminator="\r\n")
        w.writerow(RETURNS_HEADERS)
        for r in rows:
            w.writerow([r[h] for h in RETURNS_HEADERS])
    got = sorted((x.month, x.return_quantity, x.refunded_amount, x.item_name)
                 for x in load_returns_report(spark, p).collect())
    assert got[0][:3] == ("February", 3, ""), got
    assert got[0][3] in ("two\r\nlines", "two\nlines"), repr(got[0][3])
    assert got[1] == ("January", 2, "9.99", "thing")


def test_gzipped_report(spark, tmp_path):
    import gzip
    import shutil

    plain = write_returns(str(tmp_path / "r.tsv"), [returns_row("5-Jan-24", "2"), returns_row("6-Feb-24", "3")])
    gz = str(tmp_path / "in" / "r.tsv.gz")
    os.makedirs(os.path.dirname(gz))
    with open(plain, "rb") as src, gzip.open(gz, "wb") as dst:
        shutil.copyfileobj(src, dst)
    got = sorted((x.month, x.return_quantity) for x in load_returns_report(spark, gz).collect())
    assert got == [("February", 3), ("January", 2)]


def test_fail_guard_survives_column_pruning(spark, tmp_path):
    p = write_returns(str(tmp_path / "r.tsv"), [returns_row(), returns_row("5/Jan/24", "1")])
    with pytest.raises(Exception, match="rows cannot be loaded"):
        load_returns_report(spark, p).select("asin").count()
