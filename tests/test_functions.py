"""Column expressions: dates, numbers, flags, LIKE patterns, rates."""

import pytest
from pyspark.sql import functions as F

from rmalytics.functions.dates import (
    month_number,
    month_window_filter,
    purchase_month_year,
    report_month_year,
)
from rmalytics.functions.numbers import blank_to_zero_float, strict_int, text_flag
from rmalytics.functions.rates import return_rate
from rmalytics.functions.text import like_pattern, py_strip

NBSP = chr(0xA0)


def one_col(spark, values, expr_fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(expr_fn(F.col("v"))).collect()]


def test_report_date(spark):
    vals = ["5-Jan-24", "05-JAN-2024", " 5-jan-24 ", "99-Jan-24", "-Jan-24", "5-Dec-1999",
            "5/Jan/24", "5-Foo-24", "", None, "5-January-24", "5-Jan-24-1", "5-Jan-x", "5- Jan-24",
            "\t5-Jan-24" + NBSP, "5-Jan-2_024", "5-Jan-+24", "5-Jan-" + NBSP + "24"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    m, y, _ = report_month_year(F.col("v"))
    got = [tuple(r) for r in df.select(m, y).collect()]
    ok = ("January", 2024)
    assert got[:6] == [ok, ok, ok, ok, ok, ("December", 1999)]
    assert got[6:14] == [(None, None)] * 8
    assert got[14] == ok
    assert got[15:] == [ok, ok, ok]


def test_purchase_date_wall_clock(spark):
    vals = ["2024-01-01T00:30:00+09:00", "2024-01-01T00:30:00Z", "2024-01-01T00:30:00+0000",
            "2024-05-31T23:30:00-05:00", "2024-1-1T0:3:0+09:00", "2024-01-01", "2024-02-30T00:00:00Z",
            " 2024-01-01T00:30:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:30:00+09:00:00.5", None,
            "2024-01-01T00:00:60Z"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    m, y, _ = purchase_month_year(F.col("v"))
    got = [tuple(r) for r in df.select(m, y).collect()]
    jan = ("January", 2024)
    assert got == [jan, jan, jan, ("May", 2024), jan, (None, None), (None, None), (None, None),
                   (None, None), jan, (None, None), (None, None)]


def test_strict_int(spark):
    got = one_col(spark, [" 3 ", "+4", "-2", "1_000", "", "x", "1.5", None, "3" + NBSP], strict_int)
    assert got == [3, 4, -2, 1000, None, None, None, None, 3]


def test_blank_to_zero_float(spark):
    got = one_col(spark, ["", "   ", NBSP, None, "12.5", " 7 ", "12.5x", "1e3", "1_000.5", "inf",
                          "-nan", "+NaN", "-Infinity"], blank_to_zero_float)
    assert got[:4] == [0.0] * 4
    assert got[4:6] == [12.5, 7.0]
    assert got[6] is None
    assert got[7] == 1000.0 and got[8] == 1000.5 and got[9] == float("inf")
    assert got[10] != got[10] and got[11] != got[11] and got[12] == float("-inf")


def test_text_flag(spark):
    assert one_col(spark, ["TRUE", "true", "yes", "", None, " true"], text_flag) == \
        [True, True, False, False, False, False]


def test_py_strip(spark):
    assert one_col(spark, ["\t a \n", NBSP + "b" + NBSP, "c"], py_strip) == ["a", "b", "c"]


def test_month_number_and_name(spark):
    assert one_col(spark, ["January", "December", "january", "Foo", None], month_number) == \
        [1, 12, 0, 0, 0]


def test_like_pattern():
    assert like_pattern("ab") == "%ab%"
    assert like_pattern("a%b_") == "%a%b_%"
    assert like_pattern("a%b_", literal=True) == "%a\\%b\\_%"
    assert like_pattern("a\\b") == "%ab%"          # backslash before an ordinary char dropped
    assert like_pattern("a\\%") == "%a\\%%"        # escaped wildcard stays escaped
    assert like_pattern("a\\") == "%a\\\\%"        # trailing backslash is literal


def test_like_pattern_runs_in_spark(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), ("a\\b",), ("ab",)], "v string")
    for term, lit_, want in (("a%b", True, ["a%b"]), ("a%b", False, ["a%b", "axb", "a\\b", "ab"]),
                             ("a\\b", False, ["ab"]), ("a\\", True, ["a\\b"])):
        got = [r.v for r in df.filter(F.col("v").ilike(like_pattern(term, lit_))).collect()]
        assert got == want, (term, lit_)


def test_month_window(spark):
    df = spark.createDataFrame([(y, m) for y in (2023, 2024, 2025) for m in range(1, 13)],
                               "year int, month_no int")

    def months(a, b):
        return [(r.year, r.month_no) for r in df.filter(month_window_filter(a, b)).collect()]

    assert months("2024-01-15", "2024-03-31") == [(2024, 2), (2024, 3)]
    assert months("2024-03-01", "2024-03-01") == [(2024, 3)]
    assert months("2024-03-02", "2024-03-31") == []
    assert months("2023-12-02", "2024-01-01") == [(2024, 1)]
    assert len(months("2023-01-01", "2025-12-31")) == 36


@pytest.mark.parametrize("a,b,half_up,half_even", [
    (1, 800, 0.13, 0.12), (1, 3, 33.33, 33.33), (2, 3, 66.67, 66.67), (3, 800, 0.38, 0.38),
    (1, 0, None, None), (1, None, None, None), (0, 5, 0.0, 0.0), (5, 4, 125.0, 125.0),
])
def test_return_rate_rounding(spark, a, b, half_up, half_even):
    df = spark.createDataFrame([(a, b)], "a long, b long")
    r = df.select(return_rate(F.col("a"), F.col("b"), "half_up"),
                  return_rate(F.col("a"), F.col("b"), "half_even"),
                  return_rate(F.col("a"), F.col("b"), "half_even", zero_when_no_sales=True)).collect()[0]
    assert (r[0], r[1]) == (half_up, half_even)
    assert r[2] == (0.0 if half_even is None else half_even)
