"""The filter of the sales side of a search: no key is lost, few others pass."""

import uuid

import pytest
from pyspark.sql import functions as F

from rmalytics.functions.membership import key_filter, may_hold
from rmalytics.operators.search import search_products
from rmalytics.plans.warehouse import tables

SF = "/root/testdata/sf0.001"


def keys(spark, n, prefix):
    return spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("k"))


@pytest.mark.parametrize(("n", "others"), [(0, 0.0), (1, 0.001), (2000, 0.001), (100_000, 0.05)])
def test_filter_holds_its_keys_and_few_others(spark, n, others):
    of = key_filter(F.col("k"), keys(spark, n, "a").unionByName(spark.createDataFrame([(None,)], "k string")))
    inside = keys(spark, n, "a").where(may_hold(of.scalar(), F.col("k"))).count()
    outside = keys(spark, 20_000, "b").where(may_hold(of.scalar(), F.col("k"))).count()
    assert inside == n and outside <= 20_000 * others


def rows_read(spark, df):
    """Rows of a run: read by its scans, and written to its shuffles by stage."""
    group = f"rows-read-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        df.collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {k for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds}
    done = [store.lastStageAttempt(k) for k in stages]
    return sum(x.inputRecords() for x in done), {x.inputRecords(): x.shuffleWriteRecords() for x in done if x.inputRecords()}


@pytest.mark.parametrize("fold", [True, False])
def test_search_scans_each_table_once_and_shuffles_only_sales_of_matches(spark, fold):
    r, s = tables(spark, SF)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    few = search_products(r, s, "ring-17", (1996, 1997), fold_case=fold).products
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs  # none while building
    sold = s.where(F.col("year").isin(1996, 1997))
    n_sold = sold.count()
    read, written = rows_read(spark, few)
    assert read == r.count() + n_sold
    assert written[n_sold] < n_sold / 20

    # rows that pass the scan of sales: those of the matched products and a few others
    asins = [x.asin for x in few.collect()]
    key = "asin_key" if fold else "asin"
    mine = s.where(F.col("year").isin(1996, 1997)).where(F.col("asin").isin(asins)).count()
    of = key_filter(F.col(key), r.where(F.col("asin").isin(asins)))
    passed = s.where(F.col("year").isin(1996, 1997)).where(may_hold(of.scalar(), F.col(key))).count()
    every = s.where(F.col("year").isin(1996, 1997)).count()
    assert mine <= passed <= mine + 0.02 * every < every


def test_sales_are_the_same_without_the_filter(spark, monkeypatch):
    from rmalytics.operators import search

    r, s = tables(spark, SF)
    got = {term: sorted(map(tuple, search_products(r, s, term, (1996, 1997)).products.collect()), key=str) for term in ("ring", "b", "%1_")}
    monkeypatch.setattr(search, "may_hold", lambda *_: F.lit(True))
    for term, rows in got.items():
        assert rows and sorted(map(tuple, search_products(r, s, term, (1996, 1997)).products.collect()), key=str) == rows
