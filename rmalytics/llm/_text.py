"""Vectorised helpers over the UTF-8 buffer of an Arrow text column.

Spans (words, tokenizer segments) are offset pairs into one byte buffer; they
are hashed, and compared, eight bytes at a time over all spans of a batch at
once, so that per-word Python work is limited to the distinct words.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: What ``[^\x20\x09-\x0D]+`` takes as a separator.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes handled at once; a longer document is a piece of its own.
PIECE_BYTES = 8 << 20

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_PAD = b"\0" * 8


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes.

    The bytes carry eight zero bytes at the end; nulls are empty spans.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        b = min(b, n)
        buf = np.zeros(off[b] - off[a] + 8, dtype=np.uint8)
        buf[:-8] = raw[off[a] : off[b]]
        yield a, b, buf, off[a : b + 1] - off[a]
        a = b


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and each row's first word (with the end)."""
    total = int(off[-1])
    space = np.ones(total + 1, dtype=bool)
    np.take(IS_SPACE, buf[:total], out=space[:total])
    first = np.zeros(total + 1, dtype=bool)
    first[off] = True
    inside = ~space[:total]
    begins = inside.copy()
    begins[1:] &= space[: total - 1] | first[1:total]
    ends = inside
    ends &= space[1:] | first[1:]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on."""
    return np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))


def hash_spans(buf: np.ndarray, s: np.ndarray, e: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans (``buf`` padded by eight bytes).

    With a random ``key`` that texts' authors don't know, they can't make two
    spans of one hash.
    """
    lanes = _lanes(buf)
    size = e - s
    h = size.astype(np.uint64) * _M1 ^ np.uint64(key)
    h ^= lanes[s] & _MASKS[np.minimum(size, 8)]
    h = mix(h)
    rows, at = np.flatnonzero(size > 8), 8
    while len(rows):
        left = size[rows] - at
        x = h[rows] * _M1
        x ^= lanes[s[rows] + at] & _MASKS[np.minimum(left, 8)]
        h[rows] = mix(x)
        rows, at = rows[left > 8], at + 8
    return h


def equal_spans(a: np.ndarray, s: np.ndarray, e: np.ndarray, b: np.ndarray, t: np.ndarray, f: np.ndarray, skip: int = 0) -> np.ndarray:
    """Which spans (s, e) of ``a`` hold the same bytes as spans (t, f) of ``b``, the first
    ``skip`` bytes left aside (buffers padded by eight bytes)."""
    x, y, size = _lanes(a), _lanes(b), e - s
    same = size == f - t
    rows, at = np.flatnonzero(same & (size > skip)), skip
    while len(rows):
        ok = (x[s[rows] + at] ^ y[t[rows] + at]) & _MASKS[np.minimum(size[rows] - at, 8)] == 0
        same[rows[~ok]] = False
        at += 8
        rows = rows[ok & (size[rows] > at)]
    return same


#: of this process; hashes by it aren't shared
_KEY = secrets.randbits(64)
KEPT_BYTES = 64 << 20


class SpanMemo:
    """What distinct spans give, kept between batches of one Python worker.

    ``work`` gets distinct new spans as ``str`` and returns one item for each.
    Spans are found by a keyed hash and then compared byte for byte, with those
    of the batch and those kept; the few that share a hash with another span
    are kept apart by their bytes. Beyond ``limit`` items or ``KEPT_BYTES`` the
    memory starts anew, so that it is bounded; a result never depends on what
    is kept, nor on the hash.
    """

    def __init__(self, work: Callable[[list[str]], list], limit: int = 300_000, key: int = _KEY):
        self.work, self.limit, self.key = work, limit, key
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.empty(0, np.uint64), np.empty(0, np.int64)
        # the kept spans' bytes, and where each key's lie
        self.kept, self.used = np.zeros(1 << 16, np.uint8), 0
        self.start, self.end, self.lead = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.head = np.empty(0, np.uint64)  # their first eight bytes
        self.apart: dict[tuple[bytes, bool], int] = {}
        self.items: list = []

    def _keep(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = e - s
        end = self.used + np.cumsum(size)
        total = int(end[-1]) if len(end) else self.used
        if total + 8 > len(self.kept):
            room = np.zeros(2 * total + 8, np.uint8)
            room[: self.used] = self.kept[: self.used]
            self.kept = room
        start = end - size
        # all bytes of the spans, side by side
        self.kept[self.used : total] = buf[np.repeat(s - start, size) + np.arange(self.used, total)]
        self.used = total
        return start, end

    def codes(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray, lead: np.ndarray | None = None, prefix: str = "") -> np.ndarray:
        """Index into ``items`` of each span; spans where ``lead`` holds get ``prefix`` before them."""
        h = hash_spans(buf, s, e, self.key)
        flag = np.zeros(len(s), dtype=bool) if lead is None else lead
        if lead is not None:
            h[lead] = mix(h[lead] ^ _M3)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.items) > self.limit or self.used > KEPT_BYTES:
            self.clear()
        known = np.searchsorted(self.keys, distinct)
        known[known == len(self.keys)] = 0
        hit = self.keys[known] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        # a span that differs from the batch's first of its hash, or from the one kept, goes apart
        size = e - s
        head = _lanes(buf)[s] & _MASKS[np.minimum(size, 8)]
        shape = size << 1 | flag
        same = (head == head[first][inverse]) & (shape == shape[first][inverse])
        long = np.flatnonzero(size > 8)
        mine = first[inverse[long]]
        same[long] &= equal_spans(buf, s[long], e[long], buf, s[mine], e[mine], 8)
        if hit.any():
            there, here = known[hit], first[hit]
            kept = (head[here] == self.head[there]) & (flag[here] == self.lead[there])
            kept &= equal_spans(buf, s[here], e[here], self.kept, self.start[there], self.end[there], 8)
            if not kept.all():
                other = np.zeros(len(distinct), dtype=bool)
                other[np.flatnonzero(hit)[~kept]] = True
                same &= ~other[inverse]
        out = np.empty(len(distinct), dtype=np.int64)
        out[hit] = self.at[known[hit]] if len(self.keys) else 0
        new = np.flatnonzero(~hit)
        raw = buf.tobytes() if len(new) or not same.all() else b""

        def texts(rows: np.ndarray) -> list[str]:
            got = [raw[a:b].decode("utf-8", "replace") for a, b in zip(s[rows].tolist(), e[rows].tolist(), strict=True)]
            return [prefix + x if y else x for x, y in zip(got, flag[rows].tolist(), strict=True)]

        if len(new):
            rows, base = first[new], len(self.items)
            self.items.extend(self.work(texts(rows)))
            out[new] = base + np.arange(len(new))
            start, end = self._keep(buf, s[rows], e[rows])
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.at = keys[order], np.concatenate([self.at, out[new]])[order]
            fields = ((self.start, start), (self.end, end), (self.lead, flag[rows]), (self.head, head[rows]))
            self.start, self.end, self.lead, self.head = (np.concatenate(x)[order] for x in fields)
        codes = out[inverse]
        for k in np.flatnonzero(~same).tolist():
            name = (raw[s[k] : e[k]], bool(flag[k]))
            if name not in self.apart:
                self.apart[name] = len(self.items)
                self.items.extend(self.work(texts(np.array([k]))))
            codes[k] = self.apart[name]
        return codes


def sums_by_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive entries of ``rows``."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[rows])
