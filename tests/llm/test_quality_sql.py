"""The SQL of the quality rules follows the operator for null and rare languages."""

import pytest

from rmalytics.llm.quality_rules import quality_rules
from rmalytics.llm.registry import ORACLE

SF = "/root/testdata/sf0.001"


def test_sql_judges_null_and_rare_languages(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    base = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()]
    rows = base + [(10**6 + k, t, None if k < 20 else "xx" if k == 20 else "rare") for k, (_, t, _) in enumerate(base[:40])]
    rows += [(2 * 10**6 + k, t, lang) for k, t in enumerate(["#@$ %% && || " * 60, None, "", "aa bb cc " * 100]) for lang in (None, "xx", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    path = str(tmp_path / "documents")
    df.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.execute(ORACLE["op5_quality_rules"])
    names = [d[0] for d in want.description]
    got = sorted((tuple(x) for x in quality_rules(df).select(*names).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str) and len(got) == len(rows)
    kept = names.index("kept")
    assert {x[kept] for x in got} == {True, False}
