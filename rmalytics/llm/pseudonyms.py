"""Format-preserving pseudonyms for personal numbers, dates and addresses.

What is found is validated (checksum, calendar, ranges), read as a whole number
below the size of its format's value set, and permuted there by a keyed Feistel
network; numbers that fall outside walk on along their cycle until they are
inside. So a value always becomes the same other value of its format, in every
document, two values never become one, and the key's holder can go back.
Punctuation stays, and check digits are made anew:

- card numbers (Luhn), IBANs (mod 97, by their country's length), US social
  security numbers
- phone numbers: the digits after the country code. With ``+``: a country code and
  8 to 15 digits in all, single blanks, dots or dashes anywhere between them and
  brackets around the first group; ``(0)`` before it stays. Without: ten digits in
  three groups as in North America, also after ``1``, the same number as with ``+1``
- IPv4 addresses, as 32-bit numbers
- calendar dates (year-month-day, also before a time, year/month/day,
  day.month.year, month/day/year, and day/month/year where that isn't one), with
  days and months of one or two digits, the same day in any of the formats staying
  the same day. A day moves within its era (1900 to 2099, 1000 to 1899, before,
  after) and among days as wide: months to 9 or from 10, days to 9, 12 or 31
- e-mail addresses: letters and digits of the local part, and of each label
  before the last of the domain, each within its class
- access keys and secrets given by a name that holds one of a few words
  (``password=``, ``SECRET_KEY = "..."``, ``"api_token": "..."``)

Rows are independent: no shuffle. Only texts with a digit or @ are searched.

Edge cases: null text stays null with 0 values; other columns pass through,
whatever their names, except ``n_pseudonyms``, which is replaced; overlapping
finds go to the first kind in the order of ``KINDS``; numbers that fail their
check stay as they are. A value set of few members may map a value to itself.
"""

from __future__ import annotations

import bisect
import calendar
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rmalytics.llm._text import pieces, sums_by_row

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = "0123456789abcdef"
#: text searched at once, and given on as a batch
PART_BYTES = 1 << 20
#: permuted values that a worker keeps
KEPT_VALUES = 50_000
_HINT = np.zeros(256, dtype=bool)
_HINT[[*range(48, 58), 64]] = True


class Feistel:
    """Keyed permutations of 0..size-1 for any size, one for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key).digest()
        self.permuted = lru_cache(KEPT_VALUES)(self._permuted)

    def _round(self, tweak: str, size: int, k: int, half: int, below: int) -> int:
        data = f"{tweak}|{size}|{k}|{half}".encode()
        wide = hashlib.blake2b(data, key=self.key, digest_size=max(16, below.bit_length() // 8 + 9)).digest() if below.bit_length() <= 400 else b"".join(hashlib.blake2b(data + bytes([j]), key=self.key).digest() for j in range(below.bit_length() // 512 + 2))
        return int.from_bytes(wide) % below

    def _once(self, x: int, size: int, a: int, b: int, tweak: str) -> int:
        left, right = divmod(x, b)
        for k in range(0, ROUNDS, 2):
            left = (left + self._round(tweak, size, k, right, a)) % a
            right = (right + self._round(tweak, size, k + 1, left, b)) % b
        return left * b + right

    def _back(self, x: int, size: int, a: int, b: int, tweak: str) -> int:
        left, right = divmod(x, b)
        for k in range(ROUNDS - 2, -1, -2):
            right = (right - self._round(tweak, size, k + 1, left, b)) % b
            left = (left - self._round(tweak, size, k, right, a)) % a
        return left * b + right

    @staticmethod
    def _halves(size: int) -> tuple[int, int]:
        a = 1
        while a * a < size:
            a *= 2
        lo, hi = a // 2, a
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if mid * mid >= size else (mid + 1, hi)
        return lo, -(-size // lo)

    def _permuted(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        if size < 2:
            return x
        a, b = self._halves(size)
        step = self._back if back else self._once
        x = step(x, size, a, b, tweak)
        while x >= size:
            x = step(x, size, a, b, tweak)
        return x


def _in_classes(f: Feistel, text: str, tweak: str, back: bool, classes: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> str:
    """Letters and digits permuted together, each within its class; other characters stay."""
    value, size, radix = 0, 1, []
    for c in text:
        own = next((x for x in classes if c in x), None)
        radix.append(own)
        if own:
            value, size = value * len(own) + own.index(c), size * len(own)
    value = f.permuted(value, size, f"{tweak}|{''.join(str(len(x)) + '.' if x else '-' for x in radix)}", back)
    out = list(text)
    for k in range(len(text) - 1, -1, -1):
        if radix[k]:
            value, at = divmod(value, len(radix[k]))
            out[k] = radix[k][at]
    return "".join(out)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def luhn_digit(body: str) -> str:
    total = sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


#: first digits of payment cards
_ISSUERS = "23456"


def _card(f, m, back):
    d = _digits(m.group())
    if luhn_digit(d[:-1]) != d[-1] or d[0] not in _ISSUERS or not d.strip(d[0]):
        return None
    rest = 10 ** (len(d) - 2)
    x = f.permuted(_ISSUERS.index(d[0]) * rest + int(d[1:-1]), len(_ISSUERS) * rest, "card", back)
    body = f"{_ISSUERS[x // rest]}{x % rest:0{len(d) - 2}d}"
    return _refill(m.group(), body + luhn_digit(body))


def _iban_check(country: str, bban: str) -> int:
    return int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97


def _iban(f, m, back):
    flat = m.group().replace(" ", "")
    if 98 - _iban_check(flat[:2], flat[4:]) != int(flat[2:4]):
        return None
    bban = _in_classes(f, flat[4:], f"iban {flat[:2]}", back)
    it = iter(f"{flat[:2]}{98 - _iban_check(flat[:2], bban):02d}{bban}")
    return "".join(c if c == " " else next(it) for c in m.group())


#: length of an IBAN by country
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


_IBANS = "|".join(_iban_of(n, x) for n, x in _IBAN_LENGTHS.items())


def _ssn(f, m, back):
    area, group, serial = map(int, m.group().split("-"))
    area -= area > 666  # 001..665 and 667..899
    size = 898 * 99 * 9999
    x = f.permuted(((area - 1) * 99 + group - 1) * 9999 + serial - 1, size, "ssn", back)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


#: E.164 country codes of one and two digits, and how those of three begin
_CODES = r"(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[789]|8[05789]|9[679])\d|[2-9]\d)"
_GAP = "[ .\u00a0-]"


def _american(f: Feistel, digits: str, back: bool) -> str:
    """Ten digits; those that may stand without country code (not from 0 or 1) stay apart from the others."""
    national, out = digits[0] > "1", None
    while out is None or (out[0] > "1") != national:
        out = f"{f.permuted(int(out or digits), 10**10, 'phone 1', back):010d}"
    return out


def _phone(f, m, back):
    code, head = _digits(m.group("code")) or "1", m.end("code") - m.start()
    if trunk := m.groupdict().get("trunk"):
        head = m.end("trunk") - m.start()
    rest = m.group()[head:]
    d = _digits(rest)
    if not 8 <= len(code) + len(d) <= 15:
        return None
    return m.group()[:head] + _refill(rest, _american(f, d, back) if code == "1" else _in_classes(f, d, f"phone {code}", back))


def _phone_before(m: re.Match, end: int) -> re.Match | None:
    """The longest number of at most 15 digits in whole groups that starts as ``m`` and ends by ``end``."""
    text = m.string
    while m is not None and (m.end() > end or len(_digits(m.group())) > 15 + len(m.groupdict().get("trunk") or "") // 3):
        cut = max((k for k in range(m.start(), min(m.end(), end + 1)) if not text[k].isdigit()), default=m.start())
        m = m.re.match(text, m.start(), cut) if cut > m.start() else None
    return m


def _ip(f, m, back):
    x = 0
    for part in m.group().split("."):
        x = x << 8 | int(part)
    x = f.permuted(x, 1 << 32, "ipv4", back)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


_ERAS = ((1, 1000), (1000, 1900), (1900, 2100), (2100, 10000))
_MONTHS, _MONTHDAYS = ((1, 10), (10, 13)), ((1, 10), (10, 13), (13, 32))


def _is_day(y: int, m: int, d: int) -> bool:
    return 1 <= y <= 9999 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]


def _day(f: Feistel, day: tuple[int, int, int], back: bool) -> tuple[int, int, int]:
    """Another day that is written as wide and read in the same order of its parts."""
    (y0, y1), (m0, m1), (d0, d1) = (next(x for x in kinds if x[0] <= v < x[1]) for v, kinds in zip(day, (_ERAS, _MONTHS, _MONTHDAYS), strict=True))
    y, m, d = day
    months, days = m1 - m0, d1 - d0
    x = ((y - y0) * months + m - m0) * days + d - d0
    while True:
        x = f.permuted(x, (y1 - y0) * months * days, f"date {y0} {m0} {d0}", back)
        y, m, d = y0 + x // days // months, m0 + x // days % months, d0 + x % days
        if _is_day(y, m, d):
            return y, m, d


def _date(*orders: str) -> Callable:
    """By the first of the orders of year, month and day that is a calendar date."""

    def run(f, m, back):
        parts = re.findall(r"\d+", m.group())
        for order in orders:
            day = tuple(int(parts[order.index(c)]) for c in "ymd")
            if _is_day(*day):
                to = dict(zip("ymd", _day(f, day, back), strict=True))
                sep = re.search(r"\D", m.group()).group()
                return sep.join(f"{to[c]:0{len(x)}d}" for c, x in zip(order, parts, strict=True))
        return None

    return run


def _email(f, m, back):
    local, domain = m.group().rsplit("@", 1)
    *labels, top = domain.split(".")
    return _in_classes(f, local, "email", back) + "@" + ".".join([*(_in_classes(f, x, "domain", back) for x in labels), top])


def _access_key(f, m, back):
    return m.group()[:4] + _in_classes(f, m.group()[4:], "access key", back, (UPPER + DIGITS,))


def _secret(f, m, back):
    value = m.group("value")
    if not any(c.isdigit() for c in value):
        return None
    hexed = all(c in HEX for c in value)
    new = _in_classes(f, value, "secret", back, (HEX,) if hexed else (DIGITS, LOWER, UPPER))
    return m.group()[: m.start("value") - m.start()] + new + m.group()[m.end("value") - m.start() :]


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: kind, what a text must hold to be searched for it, pattern, permutation
KINDS: tuple[tuple[str, str, re.Pattern, Callable], ...] = (
    ("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9])"), _email),
    ("access key", "AKIA", re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"), _access_key),
    ("secret", "", re.compile(r"(?<![A-Za-z0-9_-])(?i:(?=[A-Z0-9_-]*?(?:password|passwd|pwd|secret|token|api[_-]?key))[A-Z0-9_-]++)[\"']?\s*[=:]\s*(?P<quote>[\"']?)(?P<value>[A-Za-z0-9_/+.~-]{8,})(?P=quote)(?<!\.)"), _secret),
    ("iban", "", re.compile(rf"(?<![A-Za-z0-9])(?:{_IBANS})(?![A-Za-z0-9])"), _iban),
    ("iban", "", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("card", "", re.compile(r"(?<![\w.])\d{13,19}(?!\w|\.\d)"), _card),
    ("card", "", re.compile(r"(?<![\w-])\d{4}([ -])(?:\d{4}\1\d{4}\1\d{4}|\d{6}\1\d{5})(?![\w-])"), _card),
    ("ipv4", ".", re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"), _ip),
    ("date", "-", re.compile(r"(?<![\w-])\d{4}-\d{1,2}-\d{1,2}(?:(?=[Tt]\d\d)|(?![\w-]))"), _date("ymd")),
    ("date", "/", re.compile(r"(?<![\w/])\d{4}/\d{1,2}/\d{1,2}(?:(?=[Tt]\d\d)|(?![\w/]))"), _date("ymd")),
    ("date", ".", re.compile(r"(?<![\w.])\d{1,2}\.\d{1,2}\.\d{4}(?!\w|\.\d)"), _date("dmy")),
    ("date", "/", re.compile(r"(?<![\w/])\d{1,2}/\d{1,2}/\d{4}(?![\w/])"), _date("mdy", "dmy")),
    ("ssn", "-", re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"), _ssn),
    ("phone", "+", re.compile(rf"(?<![\w+])\+(?P<code>1){_GAP}?(?:\(\d{{3}}\){_GAP}?\d(?:{_GAP}?\d){{6}}|\d(?:{_GAP}?\d){{9}})(?!\w)"), _phone),
    ("phone", "+", re.compile(rf"(?<![\w+])\+(?!1)(?P<code>(?>{_CODES}))(?:{_GAP}?(?P<trunk>\(0\)))?{_GAP}?(?:\(\d{{1,5}}\){_GAP}?)?\d(?:{_GAP}?\d){{2,16}}(?!\w)"), _phone),
    ("phone", "", re.compile(rf"(?<![\w.+(-])(?P<code>(?:1{_GAP})?)(?:\([2-9]\d\d\){_GAP}?|[2-9]\d\d{_GAP})\d{{3}}{_GAP}\d{{4}}(?!\w|[.-]\d)"), _phone),
)


def pseudonymised(f: Feistel, text: str, back: bool = False) -> tuple[str, int]:
    """The text with its values replaced, and their number."""
    found: list[tuple[int, int, str]] = []  # of the kinds so far, in order and apart from each other
    for _, hint, pattern, permute in KINDS:
        if hint not in text:
            continue
        ends, more = [b for _, b, _ in found], []
        for m in pattern.finditer(text):
            k = bisect.bisect_right(ends, m.start())  # the first find that ends behind the match's start
            met = k < len(found) and found[k][0] < m.end()
            if permute is _phone and (m := _phone_before(m, found[k][0] if met else len(text))) is None:
                continue
            if k < len(found) and found[k][0] < m.end():
                continue
            if (new := permute(f, m, back)) is not None:
                more.append((m.start(), m.end(), new))
        if more:
            found = list(heapq.merge(found, more))
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), len(found)


@lru_cache(maxsize=4)
def _feistel(key: bytes) -> Feistel:
    return Feistel(key)


def pseudonyms(df: DataFrame, key: bytes, text: str = "text", back: bool = False) -> DataFrame:
    """All columns, ``text`` with its values permuted (``back``: restored), and n_pseudonyms."""
    df = df.drop("n_pseudonyms") if text != "n_pseudonyms" else df
    schema = T.StructType([*(T.StructField(x.name, T.StringType() if x.name == text else x.dataType) for x in df.schema), T.StructField("n_pseudonyms", T.LongType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _feistel(key)
        for whole in batches:
            for a, b, buf, off in pieces(whole.column(at), PART_BYTES):
                batch = whole.slice(a, b - a)
                column = batch.column(at)
                rows = np.flatnonzero(sums_by_row(_HINT[buf[: off[-1]]], off) > 0)
                done = [pseudonymised(f, t, back) for t in column.take(pa.array(rows)).to_pylist()]
                n = np.zeros(len(column), dtype=np.int64)
                n[rows] = [k for _, k in done]
                changed = n > 0
                if changed.any():
                    column = pc.replace_with_mask(column, pa.array(changed), pa.array([t for t, k in done if k], column.type))
                columns = [column if k == at else c for k, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], schema.names)

    return df.mapInArrow(run, schema)
