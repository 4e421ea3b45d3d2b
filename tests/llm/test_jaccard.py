"""The join against all pairs, and the components against a plain union."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rmalytics.llm._components import components
from rmalytics.llm.jaccard_join import jaccard_components, one_of_each

SMALL = "/root/testdata/sf0.001/documents.parquet"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(k) for k in range(n)]


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), least.get(r) if s else i) for (i, _), s, r in zip(rows, sets, root, strict=True)], root, sets


def made_rows(seed, n):
    """Near copies in chains and groups, shared passages, copies, odd texts and ids."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnop") + r.choice("aeiou") + r.choice("xyz") * r.randint(0, 1)
    passage = [word() for _ in range(30)]
    rows, base = [(None, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one  TWO"), (5, "É a"), (6, "é a"), (6, "é a"), (None, "one two")], []
    for k in range(n):
        kind = r.random()
        if kind < 0.3 or not base:
            w = [word() for _ in range(r.randint(1, 90))]
        elif kind < 0.45:
            w = passage + [word() for _ in range(r.randint(0, 12))]
        else:
            w = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 2)] = [word() for _ in range(r.randint(0, 2))]
            w = w or ["x"]
        base.append(w)
        rows.append((1000 - k if r.random() > 0.03 else None, r.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize(("seed", "heavy", "block"), [(1, 65_536, 512), (2, 3, 4)])
def test_components_equal_all_pairs(spark, seed, heavy, block):
    rows = made_rows(seed, 300)
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, rid string, th int").repartition(5)
    got = jaccard_components(spark, df, most_heavy=heavy, block=block).select("doc_id", "n_shingles", "component_id").collect()
    want = brute(rows)[0]
    key = lambda x: tuple((y is None, y or 0) for y in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_documents_equal_all_pairs(spark):
    df = spark.read.parquet(SMALL)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = jaccard_components(spark, df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows)[0])


def test_one_row_of_each_component_stays(spark):
    rows = made_rows(3, 200)
    df = spark.createDataFrame([(*x, k, "keep") for k, x in enumerate(rows)], "doc_id long, text string, n int, label string")
    out = one_of_each(spark, df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    _, root, sets = brute(rows)
    kept = [k for k, s in enumerate(sets) if s]
    # one of each component with words; texts without words are linked with nothing
    empty = {rows[k] for k, s in enumerate(sets) if not s}
    assert len(got) == len({root[k] for k in kept}) + len(empty)
    assert len({root[rows.index(g)] for g in got if shingles(g[1])}) == len({root[k] for k in kept})


def test_group_of_near_copies_is_one_component(spark):
    r = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"x{r.randrange(50)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_components(spark, df, block=64).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows)[0])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(spark, df).count() == 0
    assert one_of_each(spark, df).count() == 0


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(20, 60)] + [(r.randrange(500, 700), r.randrange(500, 700)) for _ in range(150)]
    got = {x.node: x.label for x in components(spark, spark.createDataFrame(links, "x long, y long")).collect()}
    root = roots(701, links)
    nodes = {x for p in links for x in p if p[0] != p[1]}
    least = {}
    for x in nodes:
        least[root[x]] = min(least.get(root[x], x), x)
    assert got == {x: least[root[x]] for x in nodes}
    assert components(spark, spark.createDataFrame([], "x long, y long")).agg(F.count("*")).first()[0] == 0
