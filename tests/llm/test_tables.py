"""Mixing, top-k search, quality rules, WARC bundles and shards against plain versions."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rmalytics.llm.quality_rules import Params, language_references, quality_rules
from rmalytics.llm.sharding import differencing, shard_rows
from rmalytics.llm.source_mixing import min_cost_flow, mix_sources, quotas
from rmalytics.llm.topk_search import top_k
from rmalytics.llm.warc_bundles import read_bundles, read_record, read_seek_table, with_records, write_bundles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def none_last(x):
    return tuple((y is None, 0 if y is None else y) for y in x)


# --- mixing -------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, out = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in out]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return {**out, **share}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]


def test_mix_reaches_the_targets(spark):
    r = random.Random(1)
    rows = [(k, " ".join("w" * r.randint(0, 60) for _ in range(r.randint(0, 60))), r.choice(["a", "b", "é", "z", None, "Z"])) for k in range(900)]
    rows += [(None, None, "a"), (5, "", "b"), (7, "one two", "c"), (7, "one two", "c"), (8, "x " * 9000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).repartition(6)
    out = mix_sources(spark, df, F.array("source"), cell_docs=64).cache()
    assert out.count() == len(rows) and set(df.columns) <= set(out.columns)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = plain_targets(sizes), Counter()
    for x in out.collect():
        n = len(WORD.findall(x.text or ""))
        assert (x.size, x.source_size, x.credited_source) == (n, sizes[x.source], x.source)
        assert x.target == pytest.approx(want[x.source]) and x.taken == n * x.copies and x.copies in (0, 1, 2)
        taken[x.source] += x.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(4, 0.01 * t), s
    again = mix_sources(spark, df.repartition(3), F.array("source"), cell_docs=64)
    key = lambda x: none_last((x.doc_id, x.source, x.text, x.copies))
    assert sorted(map(key, again.collect())) == sorted(map(key, out.collect()))
    out.unpersist()


def test_rows_without_id_are_taken_one_by_one(spark):
    rows = [(None if k // 3 % 3 == 0 else k, f"a b c {k}", "abc"[k % 3]) for k in range(1350)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mix_sources(spark, df, F.array("source"), cell_docs=64).collect()
    taken = Counter()
    for x in out:
        taken[x.source] += x.taken
    for s, t in plain_targets(dict.fromkeys("abc", 1800)).items():
        assert abs(taken[s] - t) <= 4, s
    # some of the rows without an id are taken once more, others aren't
    assert all(len({x.copies for x in out if x.doc_id is None and x.source == s}) == 2 for s in "bc")


def test_flow_is_cheapest():
    r = random.Random(2)
    for _ in range(60):
        members = {p: [s for s in "AB" if s in p] for p in ("A", "B", "AB")}
        supply = {p: r.randint(0, 4) for p in members}
        demand = {s: r.randint(0, 9) for s in "AB"}
        flow = min_cost_flow(supply, members, demand, 2)
        used = {p: sum(flow[p, s] for s in members[p]) for p in members}
        got = {s: sum(f for (p, x), f in flow.items() if x == s) for s in "AB"}
        assert all(f >= 0 for f in flow.values()) and all(used[p] <= 2 * supply[p] for p in used) and all(got[s] <= demand[s] for s in got)
        cost = sum(max(0, used[p] - supply[p]) for p in used)
        # every division of the shared pattern's words, filled up from the others
        best = None
        for x in range(2 * supply["AB"] + 1):
            for y in range(2 * supply["AB"] - x + 1):
                fa, fb = min(demand["A"] - min(x, demand["A"]), 2 * supply["A"]), min(demand["B"] - min(y, demand["B"]), 2 * supply["B"])
                if x > demand["A"] or y > demand["B"]:
                    continue
                c = max(0, x + y - supply["AB"]) + max(0, fa - supply["A"]) + max(0, fb - supply["B"])
                best = min(best or (0, 0), (-(x + y + fa + fb), c)) if best else (-(x + y + fa + fb), c)
        assert (-sum(got.values()), cost) == best


def test_shared_documents_serve_two_sources(spark):
    rows = [(k, "w " * 10, m) for k, m in enumerate([["a"]] * 40 + [["a", "b"]] * 40 + [["b"]] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, members array<string>")
    out = mix_sources(spark, df, F.col("members"), weights=(1, 1), ratio=Fraction(1), cell_docs=16).collect()
    assert all(x.credited_source in x.members for x in out)
    taken = sum(x.taken for x in out)
    assert abs(taken - 850) <= 20 and {x.target for x in out} == {425.0}
    # nothing is repeated while fresh words are left
    assert all(x.copies <= 1 for x in out)


def test_quotas_stop_at_twice_the_size():
    got = quotas({"a": 10, "b": 100, None: 5}, (5, 2, 1), Fraction(345, 2), 2)
    assert got["a"] == 20 and got[None] == 10 and got["b"] == Fraction(345, 2) - 30
    assert quotas({}, (5,), Fraction(0), 2) == {}


def test_empty_mix(spark):
    assert mix_sources(spark, spark.createDataFrame([], "doc_id long, text string, source string"), F.array("source")).count() == 0


# --- top-k --------------------------------------------------------------------


def plain_top(rows, k=5):
    ok = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def test_top_k_equals_all_products(spark):
    r = np.random.default_rng(3)
    rows = [(k, [float(x) for x in r.normal(0, 0.2, 24)]) for k in range(700)]
    rows += [(k, [0.5] * 24) for k in range(700, 730)]  # ties
    rows += [(750, None), (751, []), (752, [None] * 24), (753, [math.nan] * 24), (754, [math.inf] * 24), (None, [0.1] * 24), (800, [1.0, 2.0]), (801, [1.0, 3.0]), (850, [0.1] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(7)
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    for block in (1024, 4):
        got = sorted(map(tuple, top_k(spark, df, F.col("vec_id") % 50 == 0, block=block).collect()))
        assert got == plain_top(exact)


def test_top_k_of_huge_components_is_exact(spark):
    rows = [(50, [1e13, 3.0, -1e13]), (1, [1e12, 5.0, 1e12]), (2, [1e12, 6.0, 1e12]), (3, [-1e3, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.vec_id) for r in top_k(spark, df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [2, 1, 3]


def test_top_k_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(spark, df, F.col("vec_id") % 50 == 0).count() == 0


# --- quality rules ------------------------------------------------------------


def plain_counts(t):
    t = t or ""
    w = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_equal_a_plain_version(spark):
    r = random.Random(4)
    bits = ["a", "b", "ab", "É", "#", "x|y", "\n", "\n\n", " ", "\t", "c d e ", "c d e ", "🙂", " "]
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "a a a a a a", *("".join(r.choice(bits) + r.choice([" ", " ", "\n", ""]) for _ in range(r.randint(1, 150))) for _ in range(150)), "w x y z " * 20_000]
    rows = [(k, t, r.choice(["en", None, "xx"])) for k, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit("clash")).withColumn("_words", F.lit(1))
    got = quality_rules(df.drop("_words")).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == plain_counts(x.text)
        assert not (x.base_failed and x.kept)


def plain_distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a)
    return math.sqrt(max(0, (kl(p) + kl(q)) / 2))


def test_distances_equal_a_plain_version(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    refs = {x.ref_lang: x for x in language_references(df).collect()}
    for x in quality_rules(df).collect():
        ref, w = refs[x.lang], WORD.findall(x.text)
        left, counts = x.text, []
        for pattern in (r"[a-z]", r"[\x20\x09-\x0D]", r"[A-Z]", r"[#*$%&|<>]", r"[0-9]", r"[\x21-\x7E]"):
            counts.append(len(re.findall(pattern, left)))
            left = re.sub(pattern, "", left)
        letters = sum(c.isalpha() for c in left)
        counts += [letters, len(left) - letters]
        assert x.char_distance is None if len(x.text) < 200 else x.char_distance == pytest.approx(plain_distance(counts, ref.ref_classes), abs=1e-9)
        common = [w.count(c) for c in ref.ref_words]
        if len(w) < 100:
            assert x.word_distance is None
        else:
            rest = ref.ref_all_words - sum(ref.ref_counts)
            assert x.word_distance == pytest.approx(plain_distance([*common, len(w) - sum(common)], [*ref.ref_counts, rest]), abs=1e-9)
        near = (x.char_distance or 0) <= Params.max_char_distance and (x.word_distance or 0) <= Params.max_word_distance
        assert x.kept == (not x.base_failed and near)


def test_clean_labelled_documents_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    out = quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id")
    assert out.where("not base_failed and not kept").count() == 0


@pytest.mark.parametrize("lang", [None, "xx"])
def test_rare_and_unknown_languages_are_judged(spark, lang):
    r = random.Random(5)
    names = ["the", "of", "and", "to", "in", "is", "that", "for", *("word" + chr(97 + k) for k in range(20))]
    rows = [(k, " ".join(r.choices(names, weights=[9] * 8 + [2] * 20, k=300)), lang) for k in range(30)]
    rows += [(100, " ".join(x + "#" * 12 for x in r.choices(names, k=300)), lang), (101, " ".join(r.choices("QXZJ", k=8)) + " " + " ".join("".join(r.choices("QXZJKV", k=6)) for _ in range(300)), lang)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    others = spark.range(1000, 61000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"))
    verdict = {x.doc_id: x for x in quality_rules(df).collect()}
    assert not any(x.base_failed for x in verdict.values())
    assert {i for i, x in verdict.items() if x.kept} == set(range(30))
    # the same, whatever lies beside it, and by either join
    for limit in ("10m", "-1"):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            among = {x.doc_id: x for x in quality_rules(df.union(others)).where("doc_id < 1000").collect()}
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert among == verdict


def test_quality_of_an_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


# --- WARC ---------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    r = random.Random(5)
    html = [None, "", "", "<p>é🙂</p>", "<p>é🙂</p>", "a\r\n\r\nWARC/1.1\r\n", "x" * 300_000, *("".join(r.choice("ab<>\n") for _ in range(r.randint(0, 6))) for _ in range(200))]
    rows = [(k if k != 9 else None, f"http://e.org/{k}" if k % 7 else None, h) for k, h in enumerate(html)]
    rows += [(1000, None, "big copy")] * 2 + [(999, "u\r\nX: y", "big copy"), (None, None, "only without id")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(4)
    folder = f"file://{tmp_path}/warc"
    manifest = write_bundles(spark, with_records(df), folder, frame_bytes=4000, bundle_bytes=20_000).collect()
    assert len(manifest) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, u, h in rows:
        b = (h or "").encode()
        to = first.get(h or "")
        to = to if to is not None and to != i else None
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if to is not None else "response", to))
    got = read_bundles(spark, folder).collect()
    assert sorted((none_last((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to)) for x in got)) == sorted(map(none_last, want))
    texts = {i: h for i, _, h in rows}
    for x in got:
        if x.record_type == "response" and x.page_id is not None:
            assert bytes(x.payload).decode() == (texts[x.page_id] or "")
    for m in r.sample(manifest, 20):
        head, _ = read_record(folder, m.bundle, m.frame, m.at, m.size)
        assert head["WARC-Record-ID"] == m.record_id and head.get("X-Page-ID") == (None if m.page_id is None else str(m.page_id))
    assert max(m.frame for m in manifest) > 0
    for name in {m.bundle for m in manifest}:
        path = tmp_path / "warc" / name
        with open(path, "rb") as f:
            frames = read_seek_table(f, path.stat().st_size)
        assert frames[0][0] == 0 and all(a + c == b for (a, c, _), (b, _, _) in zip(frames, frames[1:], strict=False))


def test_warc_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/none"
    assert write_bundles(spark, with_records(df), folder).count() == 0 and read_bundles(spark, folder).count() == 0


# --- shards -------------------------------------------------------------------


def test_differencing_known_case():
    # 8 7 6 5 4 over two shards: the largest differencing method ends at a difference of 2
    part = differencing(np.array([8, 7, 6, 5, 4]), 2)
    sums = [sum(x for x, p in zip([8, 7, 6, 5, 4], part, strict=True) if p == s) for s in (0, 1)]
    assert sorted(sums) == [14, 16]
    assert len(differencing(np.array([], dtype=int), 3)) == 0


@pytest.mark.parametrize("params", [{}, {"cell_groups": 32, "large": 4, "slot_cell": 16}])
def test_shards(spark, params):
    r = random.Random(6)
    rows = [(k, "t" * r.randint(0, 4000) + str(r.randrange(400))) for k in range(1500)]
    rows += [(k, "copy " * 30) for k in range(2000, 2500)] + [(None, None), (None, ""), (3, "same"), (3, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).repartition(5)
    got = shard_rows(spark, df, **params).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == want
    total, shard_of, slots = Counter(), defaultdict(set), defaultdict(list)
    for x in got:
        assert x.law == "bytes" and x.grown_shard is None and 0 <= x.shard < 8
        total[x.shard] += x.size
        shard_of[x.text_crc32, x.size].add(x.shard)
        slots[x.shard].append(x.slot)
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) - min(total.values()) <= (0.02 if params else 0.001) * sum(total.values())


def test_a_group_with_a_third_of_the_bytes(spark):
    rows = [(k, "hot " * 50) for k in range(1000)] + [(5000 + k, f"cold {k} " * 20) for k in range(2000)]
    got = shard_rows(spark, spark.createDataFrame(rows, "doc_id long, text string"), cell_groups=64, large=16).collect()
    total = Counter()
    for x in got:
        total[x.shard] += x.size
    hot = {x.shard for x in got if x.doc_id < 5000}
    rest = [v for s, v in total.items() if s not in hot]
    assert len(hot) == 1 and len(rest) == 7 and max(rest) - min(rest) <= 0.01 * sum(rest)


def test_shards_of_an_empty_table(spark):
    assert shard_rows(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
