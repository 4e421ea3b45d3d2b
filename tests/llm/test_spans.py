"""Spans that share a hash are told apart; pseudonyms of texts with many values."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from rmalytics.llm import _bpe, _text
from rmalytics.llm._text import SpanMemo, equal_spans, hash_spans, pieces, words
from rmalytics.llm.jaccard_join import shingle_sets
from rmalytics.llm.pseudonyms import Feistel, pseudonymised
from rmalytics.llm.registry import BYTE_BPE, tokenizer_path

#: two words with one hash where the hash has no key
CLASH = ("internationalism", "fajscrggvoqtzipd")


def spans(texts):
    ((_, _, buf, off),) = list(pieces(pa.array(texts)))
    return buf, off[:-1], off[1:]


def test_the_two_words_clash_without_a_key_only():
    buf, s, e = spans(list(CLASH))
    assert len(set(hash_spans(buf, s, e).tolist())) == 1
    assert all(len(set(hash_spans(buf, s, e, key).tolist())) == 2 for key in (1, 1 << 63, 12345678901234567))


@pytest.mark.parametrize("order", [CLASH, CLASH[::-1]])
def test_clashing_words_have_their_own_tokens(order):
    bpe = _bpe.load(tokenizer_path(BYTE_BPE))
    want = {x: len(bpe.lib.encode(x, add_special_tokens=False)) for x in CLASH}
    for batches in ([list(order)], [[x] for x in order], [[order[0]], list(order) * 2]):
        memo = SpanMemo(bpe.counts.work, key=0)
        for batch in batches:
            codes = memo.codes(*spans(batch))
            assert [memo.items[c] for c in codes] == [want[x] for x in batch]
            # with a space before them, too
            codes = memo.codes(*spans(batch), lead=np.ones(len(batch), bool), prefix=" ")
            assert [memo.items[c] for c in codes] == [len(bpe.lib.encode(" " + x, add_special_tokens=False)) for x in batch]


@pytest.mark.parametrize("bits", [0, 1, 6, 64])
def test_items_do_not_depend_on_the_hash(monkeypatch, bits):
    mask = np.uint64((1 << bits) - 1)
    monkeypatch.setattr(_text, "hash_spans", lambda buf, s, e, key=0: hash_spans(buf, s, e, key) & mask)
    r = random.Random(bits)
    memo = SpanMemo(lambda got: [x.upper() for x in got], limit=200)
    for _ in range(60):
        batch = ["".join(r.choices("abé", k=r.randint(0, 20))) for _ in range(r.randint(1, 40))]
        lead = np.array([r.random() < 0.3 for _ in batch])
        codes = memo.codes(*spans(batch), lead=lead, prefix="_")
        assert [memo.items[c] for c in codes] == [("_" if y else "") + x.upper() for x, y in zip(batch, lead, strict=True)]


def test_equal_spans_compares_all_bytes():
    r = random.Random(2)
    a = ["".join(r.choices("ab", k=r.randint(0, 30))) for _ in range(2000)]
    b = [x if r.random() < 0.5 else x[:-1] + "c" if x else "" for x in a]
    assert equal_spans(*spans(a), *spans(b)).tolist() == [x == y for x, y in zip(a, b, strict=True)]


def test_shingles_of_a_keyed_run_tell_the_words_apart():
    texts = [f"one two {x} four five six" for x in CLASH]
    (plain,), (keyed,) = (list(shingle_sets(pa.array(texts), 5, key)) for key in (0, 99))
    assert (plain[0] == plain[1]).all() and not set(keyed[0].tolist()) & set(keyed[1].tolist())


def test_pseudonyms_of_a_text_with_many_values():
    r = random.Random(1)
    addresses = [".".join(str(r.randint(0, 255)) for _ in range(4)) for _ in range(200_000)]
    text = "\n".join(f"{x} GET 2021-03-{k % 28 + 1:02d}" for k, x in enumerate(addresses))
    f, began = Feistel(b"key"), time.process_time()
    out, n = pseudonymised(f, text)
    assert n == 400_000 and time.process_time() - began < 120  # a scan of all finds for each match takes over an hour
    few = text[: 40 * 500]
    few = few[: few.rindex("\n")]
    back, m = pseudonymised(f, pseudonymised(f, few)[0], back=True)
    assert back == few and out.startswith(pseudonymised(f, few)[0]) and m > 500
