"""What a Python worker of the pipeline holds at once, over batches much larger than its parts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rmalytics.llm import jaccard_join
from rmalytics.llm.jaccard_join import OFTEN, heavy_shingles, shingle_sets
from rmalytics.llm.pseudonyms import Feistel, pseudonymised, pseudonyms

KEY = b"a key of the tests"


@pytest.fixture(scope="module")
def texts():
    """6 MB of texts, some with values, some null or empty."""
    r = random.Random(5)
    words = [f"w{r.randrange(10**6):x}" for _ in range(4000)]
    rows = [" ".join(r.choices(words, k=300)) for _ in range(3400)]
    rows[::9] = [f"{x} mail{k}@example.org" for k, x in enumerate(rows[::9])]
    rows[5], rows[6] = None, ""
    return rows


def run(batches):
    """What the batches hold, and the most MB that Python and numpy had meanwhile."""
    tracemalloc.start()
    try:
        out = list(batches)
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def in_arrow(spark, monkeypatch, kind, build):
    """The function that ``build`` gives to mapInArrow."""
    got, df = [], spark.createDataFrame([], kind)
    plain = type(df).mapInArrow
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, fn, schema, *a: got.append(fn) or plain(self, fn, schema, *a))
        build(df)
    return got[0]


def test_pseudonyms_search_and_give_small_parts(spark, monkeypatch, texts):
    work = in_arrow(spark, monkeypatch, "doc_id long, text string", lambda df: pseudonyms(df, KEY))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    out, most = run(work(iter([batch])))
    assert max(b.nbytes for b in out) < 2 << 20 and most < 30
    f = Feistel(KEY)
    want = [(k, *(pseudonymised(f, t) if t is not None else (None, 0))) for k, t in enumerate(texts)]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want


def test_shingles_are_made_of_small_parts(texts):
    _, most = run(len(sets) for sets in shingle_sets(pa.array(texts)))
    assert most < 30


def test_frequent_shingles_are_counted_over_batches(spark, monkeypatch, texts):
    work = in_arrow(spark, monkeypatch, "text string", heavy_shingles)
    rows = [f"{t} a line that very many of them end with" for t in texts[10:200]]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[a : a + 2])], ["text"]) for a in range(0, len(rows), 2)]
    found = {r["token"]: r["n"] for b in work(iter(batches)) for r in b.to_pylist()}
    sets = [x for run in shingle_sets(pa.array(rows)) for x in run]
    tokens, n = np.unique(np.concatenate(sets), return_counts=True)
    assert found == {t: c for t, c in zip(tokens.view(np.int64).tolist(), n.tolist(), strict=True) if c >= OFTEN} and max(found.values()) == len(rows)


def test_join_steps_take_few_rows_and_the_setting_goes_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    with jaccard_join._step_settings(spark):
        assert int(spark.conf.get(key)) == 1000
    assert spark.conf.get(key) == old
