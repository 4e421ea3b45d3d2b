"""Ingest parsing of composed field values.

Every case is put together from parts whose meaning is written down beside
them (FIXTURES.md section 4); what the load must give follows from the parts.
"""

import csv
import math
import os
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rmalytics.schemas import RETURNS_HEADERS, SALES_HEADERS
from rmalytics.sources.reports import load_returns_report, load_sales_report

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
BLANKS = ["", " ", "\t", chr(0xA0), "  "]

# text of a part -> its meaning; None: the value cannot be loaded
REPORT_MONTH = {"Jan": "January", "JAN": "January", "jan": "January", "Sep": "September", "May": "May",
                "Sept": None, "Foo": None, "January": None, "": None, " Jan": None}
REPORT_YEAR = {"24": 2024, "2024": 2024, "99": 2099, "1999": 1999, "0": 2000, "+24": 2024, " 24": 2024,
               "2_024": 2024, "24 ": 2024, "": None, "x": None, "1e3": None}
REPORT_JOINTS = {("-", "-"): True, ("/", "-"): False, ("-", "/"): False, ("-", "--"): False}
WHOLE = {"3": 3, "+4": 4, "-2": -2, "1_000": 1000, "07": 7, "1__0": None, "": None, "x": None, "1.5": None, "_1": None}
AMOUNT = {"12.5": 12.5, "7": 7.0, "": 0.0, "1e3": 1000.0, "1_000.5": 1000.5, ".5": 0.5, "5.": 5.0, "+3": 3.0,
          "inf": math.inf, "-nan": math.nan, "12.5x": None, "1.5f": None, "0x10": None, "1,5": None}
FLAG = {"true": True, "TRUE": True, "True": True, "false": False, "yes": False, "": False, " true": False, "1": False}
ISO_YEAR = {"2024": 2024, "1999": 1999, "24": None}
ISO_MONTH = {"01": "January", "1": "January", "12": "December", "02": "February", "13": None}
ISO_DAY = {"01": 1, "1": 1, " 1": 1, "30": 30, "31": 31, "00": None}
ISO_CLOCK = {"00:30:00": True, "0:5:7": True, "23:30:59": True, "24:30:00": False, "00:60:00": False, "00:30:60": False}
ISO_ZONE = {"+09:00": True, "Z": True, "-0500": True, "+0900": True, "+09:00:30": True, "": False, "+9": False, "z": False}


def part(table):
    return st.sampled_from(list(table.items()))


def padded(table):
    return st.tuples(st.sampled_from(BLANKS), part(table), st.sampled_from(BLANKS)).map(lambda p: (p[0] + p[1][0] + p[2], p[1][1]))


@st.composite
def report_dates(draw):
    """(text, (month, year) or None); the day is not looked at."""
    day = draw(st.sampled_from(["5", "05", "31", "99", "", "x"]))
    (first, second), joined = draw(part(REPORT_JOINTS))
    month, name = draw(part(REPORT_MONTH))
    year, number = draw(part(REPORT_YEAR))
    text = draw(st.sampled_from(BLANKS)) + day + first + month + second + year + draw(st.sampled_from(BLANKS))
    return text, (name, number) if joined and name and number is not None else None


@st.composite
def purchase_dates(draw):
    """(text, (month, year) or None)."""
    year, number = draw(part(ISO_YEAR))
    month, name = draw(part(ISO_MONTH))
    day, of_month = draw(part(ISO_DAY))
    clock, clock_ok = draw(part(ISO_CLOCK))
    zone, zone_ok = draw(part(ISO_ZONE))
    exists = None not in (number, name, of_month) and not (name == "February" and of_month >= 30)
    return f"{year}-{month}-{day}T{clock}{zone}", (name, number) if exists and clock_ok and zone_ok else None


def write(folder, header, rows):
    path = os.path.join(folder, uuid.uuid4().hex + ".tsv")
    with open(path, "w", encoding="latin-1", newline="") as f:
        w = csv.writer(f, delimiter="\t", lineterminator="\n")
        w.writerow(header)
        w.writerows([[r.get(h, "") for h in header] for r in rows])
    return path


@SETTINGS
@given(st.lists(st.tuples(report_dates(), padded(WHOLE)), min_size=1, max_size=12))
def test_returns_rows(spark, tmp_path, cases):
    rows = [{"Order ID": str(i), "Return request date": date, "Return quantity": qty, "Order quantity": "1"}
            for i, ((date, _), (qty, _)) in enumerate(cases)]
    good, bad = load_returns_report(spark, write(str(tmp_path), RETURNS_HEADERS, rows), on_error="quarantine")
    loaded = {int(x.order_id): (x.month, x.year, x.return_quantity) for x in good.collect()}
    rejected = {int(x.order_id) for x in bad.collect()}
    expected = {i: (*date, qty) for i, ((_, date), (_, qty)) in enumerate(cases) if date and qty is not None}
    assert loaded == expected
    assert rejected == set(range(len(cases))) - set(expected)


@SETTINGS
@given(st.lists(st.tuples(purchase_dates(), padded(WHOLE), padded(AMOUNT), part(FLAG)), min_size=1, max_size=12))
def test_sales_rows(spark, tmp_path, cases):
    rows = [{"amazon-order-id": str(i), "purchase-date": c[0][0], "quantity": c[1][0], "item-price": c[2][0],
             "is-business-order": c[3][0]} for i, c in enumerate(cases)]
    good, bad = load_sales_report(spark, write(str(tmp_path), SALES_HEADERS, rows), on_error="quarantine")
    loaded = {int(x.amazon_order_id): x for x in good.collect()}
    expected = {i: c for i, c in enumerate(cases) if c[0][1] and c[1][1] is not None}
    assert set(loaded) == set(expected)
    assert {int(x.amazon_order_id) for x in bad.collect()} == set(range(len(cases))) - set(expected)
    for i, ((_, date), (_, qty), (_, price), (_, business)) in expected.items():
        x = loaded[i]
        assert (x.month, x.year, x.quantity, x.is_business_order) == (*date, qty, business)
        if price is None or math.isnan(price):
            assert x.item_price is None if price is None else math.isnan(x.item_price)
        else:
            assert x.item_price == price or abs(x.item_price - price) <= 1e-6 * abs(price)
