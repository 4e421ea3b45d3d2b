"""SentencePiece (BPE kind) encoding by a table of last tokens, and decoding.

For every prefix of a part the encoding ends in exactly one token. The table
is filled from left to right: an Aho-Corasick automaton gives the pieces that
end at a character, and a piece is the last token where it encodes to itself
and agrees with the last token of the prefix before it, that is where merging
their joint characters gives back just these two. The ids are then read off
the table from the end. Merges take the best score first and the leftmost of
equals, so whether two neighbours stay apart is decided by the two alone; pairs
are tested once for a worker.

A text is cut into parts wherever two neighbouring characters stand next to
each other in no piece (before a space, around a line end): a merge across
would make such a piece. The marks-only pieces share one score, for which the
two-token test isn't proven; parts that hold two neighbouring marks are merged
directly, and so is everything of a model whose other pieces share scores.

Decoding turns each id back into its bytes, marks into spaces, and drops the
space that encoding puts before a text.

Edge cases: null text counts as empty: no ids, and the decoded text is empty;
characters the model lacks become their UTF-8 bytes' pieces; repeated rows give
a row each; a literal U+2581 is a space, as in the library.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rmalytics.llm._text import SpanMemo, pieces

MARK = "▁"
KEPT_PAIRS = 300_000
#: text cut into parts at once: arrays over its parts take some 20 times as much
PART_BYTES = 2 << 20


class Pieces:
    """The model's pieces, the table of last tokens, and what parts gave."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        own = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.id_of = {names[i]: i for i in own}
        self.score = {names[i]: lib.get_score(i) for i in own}
        self.unknown = lib.unk_id()
        self.byte_ids = {b: lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.has_bytes = all(lib.is_byte(i) for i in self.byte_ids.values())
        self.bytes_of = {i: p.replace(MARK, " ").encode() for p, i in self.id_of.items()}
        self.bytes_of |= {i: bytes([b]) for b, i in self.byte_ids.items()} if self.has_bytes else {}
        self.bytes_of.setdefault(self.unknown, " ⁇ ".encode())
        #: bytes that are neighbours in some piece, or inside one character
        self.joined = np.zeros((256, 256), dtype=bool)
        self.joined[:, 0x80:0xC0] = True
        for b in self.bytes_of.values():
            if len(b) > 1:
                x = np.frombuffer(b, dtype=np.uint8)
                self.joined[x[:-1], x[1:]] = True
        bare = [s for p, s in self.score.items() if p.strip(MARK)]
        self.by_table = len(set(bare)) == len(bare)
        self.ends = ahocorasick.Automaton()
        for p in self.id_of:
            self.ends.add_word(p, p)
        self.ends.make_automaton()
        self.whole = functools.lru_cache(KEPT_PAIRS)(lambda p: self.merged(p) == [p])
        self.apart = functools.lru_cache(KEPT_PAIRS)(lambda a, b: self.merged(a + b) == [a, b])
        self.memo = SpanMemo(self.parts, 400_000)

    def merged(self, text: str) -> list[str]:
        """Pieces and single characters after all merges, done one by one."""
        chars = list(text)
        after = [*range(1, len(chars)), -1]
        before = [*range(-1, len(chars) - 1)]
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b >= 0 and (s := self.score.get(p := chars[a] + chars[b])) is not None:
                heapq.heappush(heap, (-s, a, p))

        for i in range(len(chars) - 1):
            offer(i)
        while heap:
            _, a, p = heapq.heappop(heap)
            b = after[a]
            if not chars[a] or b < 0 or chars[a] + chars[b] != p:
                continue  # one of the two has been merged since
            chars[a], chars[b] = p, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [c for c in chars if c]

    def tokens(self, part: str) -> list[str]:
        """The part's pieces; characters without a piece stand for themselves."""
        if not self.by_table or MARK + MARK in part:
            return self.merged(part)
        n = len(part)
        last: list[str | None] = [None] * (n + 1)
        for end, p in self.ends.iter(part):
            at = end + 1 - len(p)
            if last[end + 1] is None and self.whole(p):
                left = last[at] if at == 0 or last[at] is not None else part[at - 1]
                if at == 0 or (self.apart(left, p) if left in self.id_of else True):
                    last[end + 1] = p
        out, at = [], n
        while at:
            out.append(last[at] or part[at - 1])
            at -= len(out[-1])
        return out[::-1]

    def parts(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """For each part: number of ids, the ids in decimal joined by commas, the decoded bytes."""
        out = []
        for t in texts:
            ids: list[int] = []
            for p in self.tokens(t.replace(" ", MARK)):
                if p in self.id_of:
                    ids.append(self.id_of[p])
                elif self.has_bytes:
                    ids.extend(self.byte_ids[b] for b in p.encode())
                else:
                    ids.append(self.unknown)
            out.append((len(ids), ",".join(map(str, ids)).encode(), self.decoded(ids)))
        return out

    def decoded(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def _cuts(buf: np.ndarray, off: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of parts, and each row's first part (with the end)."""
    total = int(off[-1])
    first = np.zeros(total + 1, dtype=bool)
    first[off] = True
    if total > 1:
        first[1:total] |= ~joined[buf[: total - 1], buf[1:total]]
    first[total] = False
    s = np.flatnonzero(first)
    return s, np.append(s[1:], total) if len(s) else s, np.searchsorted(s, off)


def piece_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_tokens and SHA-256 of the ids (decimal, joined by commas) and of the
    decoded text; ``with_text`` adds ``ids`` (that string) and ``decoded``."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for a, b, buf, off in pieces(batch.column(1), PART_BYTES):
                s, e, rows = _cuts(buf, off, model.joined)
                lead = np.zeros(len(s), dtype=bool)
                lead[rows[:-1][np.diff(off) > 0]] = True  # the space before a text
                codes = model.memo.codes(buf, s, e, lead, " ").tolist()
                items, first = model.memo.items, rows.tolist()
                cols: list[list] = [[] for _ in names[1:]]
                for x, y in zip(first, first[1:], strict=False):
                    own = [items[c] for c in codes[x:y]]
                    ids, back = b",".join([p[1] for p in own]), b"".join([p[2] for p in own])[1:]  # without the space before
                    row = [sum([p[0] for p in own]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()]
                    for c, v in zip(cols, [*row, ids.decode(), back.decode("utf-8", "replace")], strict=False):
                        c.append(v)
                kinds = [pa.int64(), *[pa.string()] * (len(names) - 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    # a literal mark is a space to the model
    plain = F.replace(F.col(text).cast("string"), F.lit(MARK), F.lit(" "))
    schema = ", ".join(f"{n} {'long' if k < 2 else 'string'}" for k, n in enumerate(names))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), plain.alias("text")).mapInArrow(run, schema)
