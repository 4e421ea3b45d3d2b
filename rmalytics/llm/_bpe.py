"""Byte-level BPE of a ``tokenizers`` file, with cuts that never change the tokens."""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np

from rmalytics.llm._text import IS_SPACE, SpanMemo

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[list(b".,;:!?")] = True


class IdMemo(SpanMemo):
    """Items are (start, end) in one pool of token ids."""

    def clear(self) -> None:
        super().clear()
        self.pool, self.bounds = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the spans one after the other, and the number in each span."""
        done = len(self.bounds) - 1
        if done < len(self.items):
            new = self.items[done:]
            sizes = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
            self.pool = np.concatenate([self.pool, np.fromiter(itertools.chain.from_iterable(new), dtype=np.uint32, count=int(sizes.sum()))])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
            self.items[done:] = [None] * len(new)
        start = self.bounds[codes]
        sizes = self.bounds[codes + 1] - start
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(start - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


class ByteBpe:
    """The library's tokenizer, and where its pre-tokenizer always cuts.

    The byte-level pattern's tokens are a contraction, or letters, digits or
    other signs with at most one space *before* them, or white space. So no
    token reaches from a non-space into white space, or from a letter into a
    point or comma, whatever stands further left or right: such places are
    stable, and the parts between them are encoded alike alone and in place.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        #: whether the cuts are proven for this file; else a text is one part
        self.cuttable = (
            spec.get("normalizer") is None
            and spec.get("post_processor") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex") is True
            and pre.get("add_prefix_space") is False
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() or c in ".,;:!?" for c in t["content"]) for t in added)
        )
        self.counts = SpanMemo(lambda texts: [len(e) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)], 1_500_000)
        self.ids = IdMemo(lambda texts: [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)], 1_000_000)

    def parts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the parts between stable cuts, and each row's first part (with the end)."""
        total = int(off[-1])
        first = np.zeros(total + 1, dtype=bool)
        first[off] = True
        if self.cuttable and total > 1:
            d = buf[:total]
            space = IS_SPACE[d]
            at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
            # the last byte of what may be a wider space (U+0085, U+00A0, U+1680, U+2000..U+3000) makes no cut
            last, two, three = d[at - 1], d[np.maximum(at - 2, 0)], d[np.maximum(at - 3, 0)]
            wide = ((two == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((last >= 0x80) & (three >= 0xE1) & (three <= 0xE3))
            first[at[~wide]] = True
            first[1:total] |= _POINT[d[1:]] & _LETTER[d[:-1]]
        first[total] = False
        s = np.flatnonzero(first)
        e = np.append(s[1:], total) if len(s) else s
        return s, e, np.searchsorted(s, off)


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One tokenizer for each Python worker and file."""
    return ByteBpe(path)
