"""Every registered plan against its DuckDB oracle on the smallest driver data."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from rmalytics.plans.registry import ORACLE, QUERIES
from tools.compare import TABLES, digest

SF = "/root/testdata/sf0.001"
DUCK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}



@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    otypes = dict(zip(ocols, [str(d[1]) for d in cur.description]))
    assert {c: DUCK_TYPES.get(t, t) for c, t in df.dtypes} == otypes
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["asin", "merchant_sku", "total_returns", "total_sold", "return_pct"]
    assert 0 < df.count() <= 50


def test_mixed_case_plans_exercise_folding(spark):
    """On the mixed-case returns, exact comparison splits groups that folding joins."""
    from rmalytics import export_returns
    from rmalytics.plans.registry import EXPORT_END, EXPORT_START, mixed_case_returns
    from rmalytics.plans.warehouse import tables

    r, _ = tables(spark, SF)
    m = mixed_case_returns(r)
    folded = export_returns(m, EXPORT_START, EXPORT_END).count()
    exact = export_returns(m, EXPORT_START, EXPORT_END, fold_case=False).count()
    assert folded == export_returns(r, EXPORT_START, EXPORT_END).count()
    assert exact > folded
