"""Plan checks: pruning, pushdown, top-k, hash aggregation, no Python in plans."""

import contextlib
import io

import pytest

from rmalytics.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    names = [n for n in QUERIES if not n.startswith(("ingest_", "export_csv", "stream_"))]
    return {n: plan(QUERIES[n](spark, SF)) for n in names}


def test_no_python_in_any_plan(plans):
    for name, p in plans.items():
        for op in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
            assert op not in p, (name, op)


def test_no_sort_aggregate(plans):
    for name, p in plans.items():
        assert "SortAggregate" not in p, name


def test_top_returned_prunes_every_scan_to_the_year(plans):
    details = plans["top_returned_skus"].split("\n\n\n", 1)[1]
    scans = [b for b in details.split("\n\n") if b.lstrip().startswith("(") and "Scan parquet" in b]
    assert scans and all("PartitionFilters: [isnotnull(year" in b and "= 1996)]" in b for b in scans)


def test_top_returned_plan(plans):
    p = plans["top_returned_skus"]
    assert "TakeOrderedAndProject" in p
    assert "LeftSemi" in p and "BroadcastExchange" in p
    assert "PartitionFilters: [isnotnull(year" in p and "= 1996)]" in p
    assert "ReadSchema: struct<return_quantity:int,asin_key:string,sku_key:string>" in p


def test_search_reads_only_search_years_of_sales(plans):
    p = plans["product_search"]
    assert "year#" in p and "IN (1996,1997)" in p.replace(", ", ",")


def test_export_prunes_and_pushes(plans):
    p = plans["export_range"]
    assert "PartitionFilters" in p and "PushedFilters" in p and "month_no" in p


def test_suggest_is_top_k(plans):
    assert "TakeOrderedAndProject" in plans["suggest_skus"]


def test_search_without_broadcasts(spark):
    """No side small enough to broadcast: one scan of each table, a sort-merge
    join without exchanges of its own, and raw rows only ever meet
    HashAggregates (the spelling aggregate sees pre-aggregated rows)."""
    from rmalytics.operators.search import search_products
    from rmalytics.plans.warehouse import tables

    r, s = tables(spark, SF)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {fold: plan(search_products(r, s, "ring", (1996, 1997), fold_case=fold).products)
                 for fold in (False, True)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for fold, p in plans.items():
        assert "SortMergeJoin" in p and "BroadcastExchange" not in p
        tree = p.split("\n\n\n")[0]
        lines = tree.splitlines()
        assert sum("Scan parquet" in ln for ln in lines) == 2, tree
        # exact: (asin, sku), (asin), sales (asin), final sort; folded adds (key, spelling)
        assert tree.count("Exchange (") == (5 if fold else 4), tree
        scan = max(i for i, ln in enumerate(lines) if "Scan parquet" in ln and ":" in ln)
        assert "HashAggregate" in "".join(lines[scan - 3:scan]) and "Object" not in lines[scan - 2]


def test_report_plans_use_the_stored_keys(plans):
    """Texts are folded once, at ingest; the derived spellings aside, no plan folds them again."""
    derived = ("mixed_case", "_gaps", "padded", "nested_reasons")
    for name, p in plans.items():
        if not any(d in name for d in derived):
            assert "translate(" not in p, name
