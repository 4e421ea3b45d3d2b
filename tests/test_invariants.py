"""Cross-operator invariants on the driver data and JSON output."""

import json

import pytest
from pyspark.sql import functions as F

from rmalytics import export_returns, monthly_pivot, returns_by_year_month, search_products
from rmalytics.operators.monthly import SLOTS
from rmalytics.plans.warehouse import tables
from rmalytics.schemas import MONTHS
from rmalytics.sources.json_out import json_rows, series_json

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rs(spark):
    return tables(spark, SF)


def test_slots_add_up_to_series(rs):
    r, _ = rs
    series = {}
    for x in returns_by_year_month(r).collect():
        if x.month in MONTHS:
            series[x.year] = series.get(x.year, 0) + x.total_return_quantity
    piv = {x.year: x for x in monthly_pivot(r).collect()}
    assert {y: sum(p[s] for s in SLOTS) for y, p in piv.items()} == series
    assert all(p.total == sum(p[s] for s in SLOTS) for p in piv.values())


def test_export_over_whole_range_is_all_units(rs):
    r, _ = rs
    ex = export_returns(r, "1990-01-01", "2010-12-31")
    assert ex.agg(F.sum("return_quantity")).collect()[0][0] == r.agg(F.sum("return_quantity")).collect()[0][0]
    per_sku = r.groupBy("asin", "merchant_sku").agg(F.sum("return_quantity").alias("q"))
    assert ex.count() == per_sku.count()


def test_reason_counts_add_up(rs):
    r, s = rs
    res = search_products(r, s, "e", (1996, 1997))
    summ = res.summary.collect()[0]
    comb = res.combined_reasons.agg(F.sum("count_1996"), F.sum("count_1997")).collect()[0]
    assert (comb[0], comb[1]) == (summ.total_returns_1996, summ.total_returns_1997)
    reasons = res.reasons.agg(F.sum("count_1997")).collect()[0][0]
    assert reasons == summ.total_returns_1997


def test_json_outputs(rs, spark):
    r, _ = rs
    rows = [json.loads(x.json) for x in json_rows(monthly_pivot(r)).collect()]
    assert set(rows[0]) == {"year", *SLOTS, "total"}
    series = json.loads(series_json(monthly_pivot(r)).collect()[0][0])
    piv = {str(x.year): [x[s] for s in SLOTS] for x in monthly_pivot(r).collect()}
    assert series == piv
