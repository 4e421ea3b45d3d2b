"""Exact duplicates, fill-in-the-middle and hard negatives against plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rmalytics.llm.exact_dedup import BinaryFuse, exact_dedup
from rmalytics.llm.fill_in_middle import Units, fill_in_middle, restored
from rmalytics.llm.hard_negatives import Codes, Queries, Rotation, hard_negatives
from rmalytics.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def none_last(row):
    return tuple((x is None, "" if x is None else str(x)) for x in row)


# --- exact duplicates -----------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 4096, 50_000])
def test_filter_holds_its_keys_and_few_others(n):
    r = np.random.default_rng(n)
    keys = r.integers(0, 1 << 63, n, dtype=np.uint64)
    kept = BinaryFuse.from_bytes(BinaryFuse.build(np.concatenate([keys, keys])).to_bytes())
    assert kept.holds(keys).all()
    others = r.integers(1 << 63, (1 << 64) - 1, 100_000, dtype=np.uint64)
    assert kept.holds(others).mean() < 0.008
    if n >= 4096:
        assert len(kept.slots) < 1.5 * n


def plain_dedup(rows):
    spaces = re.compile(r"[\x20\x09-\x0D]+")
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[spaces.sub(" ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min(ids, key=lambda x: (x is None, x or 0))
        for k, doc_id in enumerate(sorted(ids, key=lambda x: (x is None, x or 0))):
            out.append((doc_id, keep, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=none_last)


def dedup_rows(n=600, seed=2):
    r = random.Random(seed)
    texts = ["", " ", "  \t", "a b", "a  b", "a\n\x0bb", "a b", " a b", "a b ", "long word " * 20_000, *(f"text {k}" for k in range(60))]
    rows = [(None if r.random() < 0.1 else r.randint(0, 500), r.choice([*texts, None])) for _ in range(n)]
    hot = [(None, "the same\tpassage")] * 150 + [(1000 + k, "the same  passage") for k in range(150)]
    return rows + hot + [(7, "twice")] * 2


def as_rows(df, columns=("doc_id", "keep_id", "group_size", "kept", "text_sha256")):
    return sorted((tuple(x) for x in df.select(*columns).collect()), key=none_last)


def clash(df):
    for c in ("keep_id", "batch", "digest", "rid", "kept", "n"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_dedup_equals_plain_grouping(spark):
    rows = dedup_rows()
    df = clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(7)
    assert as_rows(exact_dedup(spark, df, bucket_digests=8)) == plain_dedup(rows)
    by_id = F.when(F.col("doc_id") < 250, 0).when(F.col("doc_id") < 400, 1).otherwise(2)
    assert as_rows(exact_dedup(spark, df, batch=by_id)) == plain_dedup(rows)


def test_clashing_digests_are_told_apart_by_bytes(spark):
    rows = dedup_rows(200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = as_rows(exact_dedup(spark, df, digest_bits=8, bucket_digests=4), ["doc_id", "keep_id", "group_size", "kept"])
    assert got == [x[:4] for x in sorted(plain_dedup(rows), key=lambda x: none_last(x[:4]))]


def test_dedup_of_empty_and_single_batches(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(spark, df).collect() == []
    rows = [(3, "x"), (2, "x"), (None, None), (None, "")]
    assert as_rows(exact_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), batches=1)) == plain_dedup(rows)


def test_texts_are_shuffled_once(spark):
    df = spark.createDataFrame([(k, f"text {k % 9}") for k in range(50)], "doc_id long, text string")
    exact_dedup(spark, df, batches=2).collect()
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith("rmalytics_texts_")]
    assert tables == []  # a run leaves nothing in the catalog


# --- fill in the middle ---------------------------------------------------------


def plain_middle(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


def middle_rows():
    r = random.Random(5)
    bits = ["a", "\n", "é\n", "🙂", "\r\n", "<", "P>", "<P", "S>", "M", "<S", " ", "x y\n", " ", "\x00"]
    made = ["".join(r.choices(bits, k=r.randint(0, 30))) for _ in range(300)]
    fixed = [None, "", "\n", "\n\n", "a", "<P>", "x<S>y\n", "a<M>", "<P", "line\n" * 3000, "x" * 100_000, "\n" * 700_000 + "end"]
    return [(None if k % 17 == 3 else k // 2, t) for k, t in enumerate(fixed + made)] + [(1, "twice\nb")] * 2


@pytest.mark.parametrize(("rate", "span"), [(100, 1 << 18), (60, 16)])
def test_middle_equals_plain_cuts(spark, rate, span):
    rows = middle_rows() if span > 16 else [x for x in middle_rows() if len(x[1] or "") < 20_000]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit("clash")).withColumn("n", F.lit("clash")).repartition(4)
    out = fill_in_middle(df, rate=rate, span=span).withColumn("back", restored(F.col("output"), F.col("form")))
    got = sorted((tuple(x) for x in out.collect()), key=none_last)
    assert got == sorted((plain_middle(*x, rate=rate) for x in rows), key=none_last)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_units_of_a_long_text_are_those_of_its_runs():
    r = random.Random(6)
    for _ in range(200):
        t = "".join(r.choices("ab\n\n", k=r.randint(0, 60)))
        want = [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+", t)]
        assert Units(span=r.randint(1, 20)).ends(t) == want == Units().ends(t)


def test_middle_of_an_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- hard negatives -------------------------------------------------------------


def plain_negatives(rows, anchors, positives=5, negatives=3, least=50, most=95, unit=100):
    rows = [(i, lab, [int(np.floor(256 * x)) if abs(x) < 1e300 else 256 * int(x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, v in rows:
        if i % anchors:
            continue
        score = [(sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in rows if len(w) == len(v)]
        best = sorted(((-s, j) for s, j, m in score if m == lab and j != i))[:positives]
        for s, j in best:
            hard = sorted((-t, k) for t, k, m in score if m != lab and least * -s <= unit * t <= most * -s)[:negatives]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(hard, 1)]
    return sorted(out)


def negatives_of(spark, rows, anchors, **params):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("anchor", F.lit("clash"))
    out = hard_negatives(spark, df.repartition(3), F.col("vec_id") % anchors == 0, **params)
    return sorted(tuple(x) for x in out.collect())


@pytest.mark.parametrize("dims", [1, 3, 24, 64, 100])
def test_intervals_always_hold(dims):
    r = np.random.default_rng(dims)
    x = np.floor(256 * np.concatenate([r.normal(size=(300, dims)), r.normal(size=(50, dims)) * 1e-2, np.zeros((2, dims)), np.eye(dims)[:3]]))
    rotation = Rotation(dims, 3)
    assert np.allclose(rotation(x) @ rotation(x).T, x @ x.T, atol=1e-6 * 256**2 * dims)
    codes, queries = Codes(x, rotation), Queries(x, rotation)
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    for k in range(0, len(x), 7):
        low, high = queries.intervals(k, codes)
        cosine = unit @ unit[k]
        assert (low <= cosine + 1e-9).all() and (cosine <= high + 1e-9).all()
        if dims >= 24 and k == 0:
            assert (high - low).mean() < 1.9


def test_close_neighbours_leave_far_rows_out():
    r = np.random.default_rng(1)
    rotation = Rotation(256, 3)
    x = r.normal(size=(2000, 256))
    q = x[:1] + 0.1 * r.normal(size=(1, 256))
    low, high = Queries(q, rotation).intervals(0, Codes(x, rotation))
    cosine = float(x[0] @ q[0] / np.linalg.norm(x[0]) / np.linalg.norm(q[0]))
    assert (high >= cosine).sum() < 100  # most rows' intervals end below the best score


def test_negatives_equal_plain_search(spark):
    r = random.Random(8)
    rows = [(k, r.randint(0, 3), [r.gauss(0.2, 1) for _ in range(12)]) for k in range(260)]
    rows += [(k, 1, [r.gauss(0, 1) for _ in range(5)]) for k in range(300, 330)]
    rows += [(k, k % 2, [0.5, 0.25, 1.0]) for k in range(400, 440)] + [(440, 1, [0.5, 0.25, 0.4]), (441, 0, [0.5, 0.2, 0.4])]
    rows += [(500, None, [1.0] * 12), (501, 1, None), (502, 1, [1.0] * 11 + [None]), (510, 2, [float("nan")] * 12), (None, 1, [1.0] * 12), (511, 1, []), (512, 1, [float("inf")] * 12)]
    rows += [(600, 1, [0.0] * 12), (20, 2, rows[20][2])]  # a zero vector, a repeated id
    want = plain_negatives(rows, 10)
    assert len(want) > 200
    assert negatives_of(spark, rows, 10, block=7, chunk_elements=300) == want
    assert negatives_of(spark, rows, 10) == want


def test_scores_beyond_float64_are_whole(spark):
    r = random.Random(9)
    rows = [(k, k % 2, [float(r.randint(-(1 << 21), 1 << 21)) + 2.0**-8 for _ in range(4)]) for k in range(60)]
    rows += [(100 + k, k % 2, [1e7 + k, 3e7, float(k)]) for k in range(30)]
    assert negatives_of(spark, rows, 5) == plain_negatives(rows, 5)
    huge = [(k, k % 2, [1.5e308, float(k)]) for k in range(8)]
    assert negatives_of(spark, huge, 4) == []  # beyond long, scores are held at its end: no negative is below 95 percent


def test_number_of_jobs_does_not_grow_with_the_anchors(spark):
    def jobs(n):
        df = spark.createDataFrame([(k, k % 2, [float(k % 7), 1.0, float(k % 3)]) for k in range(n)], "vec_id long, label int, embedding array<double>").coalesce(2)
        group = f"negatives-{n}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            hard_negatives(spark, df, F.col("vec_id") % 2 == 0, block=4).collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(160) <= jobs(20) + 3


def test_negatives_of_tables_without_rows_or_anchors(spark):
    assert negatives_of(spark, [], 10) == []
    assert negatives_of(spark, [(3, 1, [1.0, 2.0])], 10) == []
    assert negatives_of(spark, [(10, 1, [1.0, 2.0])], 10) == []


# --- the registered queries -----------------------------------------------------


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_fill_in_middle", "op13_hard_negatives"])
def test_registered_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(x) for x in got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)
