"""Token counts, token files and pieces against the libraries, row by row."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rmalytics.llm import _bpe
from rmalytics.llm.piece_tokens import load as load_pieces
from rmalytics.llm.piece_tokens import piece_tokens
from rmalytics.llm.registry import BYTE_BPE, PIECES, tokenizer_path
from rmalytics.llm.token_binary import decode_ranks, encode_ranks, ids_crc32, token_binary
from rmalytics.llm.token_counts import resynchronised_count, token_counts

SMALL = "/root/testdata/sf0.001/documents.parquet"
BITS = ["a", "b", " ", "  ", "\n", "th", "e", ".", ",", "'s", "é", "1", "🙂", "ing", "ß", "́", "\u0085", " ", "!", "字", "\x00", "▁", "<s>", "<|endoftext|>", "　", "x. "]


def odd_texts(n=400, seed=3):
    r = random.Random(seed)
    made = ["".join(r.choices(BITS, k=r.randint(1, 40))) for _ in range(n)]
    return [None, "", " ", "   ", "\n", "a", "a", " a ", "don't I'll", "word " * 400, "x" * 3000, *made]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 3 else k // 2 if k < 8 else k, t) for k, t in enumerate(odd_texts())]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    own = spark.read.parquet(SMALL).select("doc_id", "text").withColumn("n_tokens", F.lit("clash"))
    return odd.unionByName(own.withColumn("doc_id", F.col("doc_id") + 10_000)).repartition(5)


def library():
    return _bpe.load(tokenizer_path(BYTE_BPE)).lib


def test_counts_match_the_library(docs):
    lib = library()
    got = token_counts(docs, tokenizer_path(BYTE_BPE), chunk=500, overlap=8).collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False)), n > 512) for r in docs.collect()]
    key = lambda x: (x[0] is None, *[y or 0 for y in x])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_resynchronisation_of_texts_without_stable_places():
    bpe = _bpe.load(tokenizer_path(BYTE_BPE))
    r = random.Random(4)
    for t in ["y" * 5000, " " * 2000 + "z", "ab " * 900, *("".join(r.choices(BITS, k=900)) for _ in range(12))]:
        assert resynchronised_count(bpe, t, 64, 4) == len(bpe.lib.encode(t, add_special_tokens=False))


def test_rank_coding_round_trip():
    r = np.random.default_rng(5)
    for top in (1, 200, 300, 70_000, 1 << 32):
        for n in (0, 1, 3, 4, 5, 1001):
            x = r.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            control, data = encode_ranks(x)
            assert len(control) == -(-n // 4)
            assert (decode_ranks(control, data, n) == x).all()


def test_files_hold_every_document_in_order(spark, docs):
    lib = library()
    got = ids_crc32(token_binary(spark, docs, tokenizer_path(BYTE_BPE))).orderBy("start").collect()
    texts = {}
    for r in docs.collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        texts.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert len(got) == docs.count()
    start = 0
    for r in got:
        assert r.start == start
        texts[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_pieces_match_the_library(docs):
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = piece_tokens(docs, tokenizer_path(PIECES)).collect()
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", num_threads=1)
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids) if ids else "")))
    key = lambda x: (x[0] is None, *[y or 0 for y in x])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_table_of_last_tokens_equals_merging():
    model = load_pieces(tokenizer_path(PIECES))
    r = random.Random(6)
    for _ in range(3000):
        part = "▁" * r.randint(0, 1) + "".join(r.choices("abcdeilnorstu.,éß", k=r.randint(1, 24)))
        assert model.tokens(part) == model.merged(part)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(none, tokenizer_path(BYTE_BPE)).count() == 0
    assert piece_tokens(none, tokenizer_path(PIECES)).count() == 0
    assert token_binary(spark, none, tokenizer_path(BYTE_BPE)).count() == 0


def test_tokenizer_files_stay_outside_the_repository():
    assert not os.path.exists(os.path.join(os.path.dirname(__file__), BYTE_BPE))


def test_pieces_are_worked_on_in_small_parts(spark, monkeypatch):
    """Arrays over a part's spans, several times its bytes, stay small in every worker."""
    import pyarrow as pa

    from rmalytics.llm import piece_tokens as module
    from rmalytics.llm.registry import PIECES, tokenizer_path

    seen = []
    real = module.pieces
    monkeypatch.setattr(module, "pieces", lambda *a: (seen.append(len(x[2])) or x for x in real(*a)))
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    grabbed = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: grabbed.append(f))
    module.piece_tokens(df, tokenizer_path(PIECES))
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(["some words " * 10_000] * 60)], ["doc_id", "text"])
    out = list(grabbed[0](iter([batch])))
    assert sum(b.num_rows for b in out) == 60 and max(seen) <= (2 << 20) + 8
