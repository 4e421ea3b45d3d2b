"""The pipeline stage by stage against plain versions, and the registered queries against SQL."""

import hashlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from rmalytics.llm.pseudonyms import Feistel, pseudonymised
from rmalytics.llm.registry import ORACLE, PIECES, PSEUDONYM_KEY, QUERIES, tokenizer_path
from tests.llm.test_jaccard import brute, shingles
from tests.llm.test_tables import WORD, plain_counts, plain_targets
from tools.compare import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents and the result of each stage, each written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_all_but_the_last_stage_return_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "PII", "mixing sources", "SentencePiece"]
    assert all(x.columns == stages[0].columns for x in stages[1:-1])


def test_quality_stage(spark, stages):
    kept = {r.doc_id for r in QUERIES["op5_quality_rules"](spark, SF).where("kept").collect()}
    rows = stages[1].collect()
    assert {r.doc_id for r in rows} == kept and len(rows) == len(kept)
    assert not any(plain_counts(r.text)[-1] for r in rows)
    assert set(rows) <= set(stages[0].collect())


def test_near_duplicate_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {c for _, _, c in brute(rows)[0]}
    got = stages[2].collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want) and set(got) <= set(stages[1].collect())


def test_personal_data_stage(stages):
    f = Feistel(PSEUDONYM_KEY)
    want = {r.doc_id: (pseudonymised(f, r.text)[0], r.lang, r.source) for r in stages[2].collect()}
    got = stages[3].collect()
    assert {r.doc_id: (r.text, r.lang, r.source) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_mixing_stage(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    got = stages[4].collect()
    copies = Counter(r.doc_id for r in got)
    assert set(got) <= set(before.values()) and max(copies.values()) <= 2
    size = {i: len(WORD.findall(r.text)) for i, r in before.items()}
    sources, taken = Counter(), Counter()
    for i, r in before.items():
        sources[r.source] += size[i]
        taken[r.source] += size[i] * copies[i]
    for s, t in plain_targets(sources).items():
        # within half the smallest document that could still be added or left out
        assert abs(taken[s] - t) <= max(size[i] for i, r in before.items() if r.source == s), s
    assert abs(sum(taken.values()) - 1.5 * sum(sources.values())) <= 0.1 * sum(sources.values())


def test_last_stage(stages):
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    want = Counter()
    for r in stages[4].collect():
        ids = lib.encode(r.text, num_threads=1)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), lib.decode(ids))]
        want[r.doc_id, len(ids), *sha] += 1
    assert Counter(map(tuple, stages[5].collect())) == want


def test_stages_take_empty_and_odd_documents(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "one two " * 3, None, None, 24), (3, "ab " * 20_000, "xx", "s", 60_000)]
    for data in ([], rows):
        df = spark.createDataFrame(data, kind)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert out.count() <= 2 * len(data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(names) and len(got) == len(rows)
    assert digest(df.columns, got)[0] == digest(names, rows)[0]


def test_ten_queries_and_the_pipeline_are_registered():
    from __spark_entry__ import queries

    names = list(queries())
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))


def test_shingles_follow_the_contract():
    assert shingles("A b\tC d E") == {("a", "b", "c", "d", "e")} and shingles("É a") == {("É", "a")} and shingles(" ") == set()
