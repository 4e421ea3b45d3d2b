"""Fill-in-the-middle documents: prefix, middle and suffix by repeated captures.

One ``fullmatch`` of ``(unit)*`` with the regex library keeps every repetition
of its group: ``match.ends(1)`` holds the end of each unit, so that its length
is the number n of units and two of its entries are the cuts; no unit is
visited in Python. The library's memory for captures grows with the units, so a
text of more than ``SPAN`` characters is matched in runs of whole units.

The cuts and the form follow from a hash of the id alone: with h1 to h4 the
first four groups of eight hex digits of sha256 of ``<seed>:<id>``, the prefix
ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after
the larger; the document stays plain if it is empty, contains a sentinel or
h3 % 100 >= ``rate``; else it is suffix-prefix-middle if h4 % 100 < ``spm``,
and prefix-suffix-middle otherwise.

Edge cases: a null text counts as empty (plain, 0 units); a null id is hashed as
the word ``null``; rows are independent, so that repeated rows give equal rows;
a very long line is one unit, and a very long text takes memory in proportion to
its length; an empty table gives no rows; other columns, clashing ones included,
are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a line with its end, or a last line without one; no unit is empty
LINES = r"[^\n]*+\n|[^\n]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPAN = 1 << 18
#: characters after which a task hands on the rows that it has
GIVEN_CHARS = 8 << 20


class Units:
    """Ends of the units of a text. Every unit but the last ends with ``end``."""

    def __init__(self, unit: str = LINES, end: str = "\n", span: int = SPAN):
        # possessive: a repetition is never given back, as units can't be cut in another way
        self.whole, self.end, self.span = regex.compile(f"({unit})*+"), end, span

    def _runs(self, text: str) -> Iterator[tuple[int, int]]:
        """Runs of whole units, of about ``span`` characters."""
        a = 0
        while len(text) - a > self.span:
            cut = text.rfind(self.end, a, a + self.span)
            if cut < 0:
                cut = text.find(self.end, a + self.span)
            if cut < 0:
                break
            yield a, cut + len(self.end)
            a = cut + len(self.end)
        yield a, len(text)

    def ends(self, text: str) -> list[int]:
        if len(text) <= self.span:
            return self.whole.fullmatch(text).ends(1)
        out: list[int] = []
        for a, b in self._runs(text):
            out += self.whole.fullmatch(text, a, b).ends(1)
        return out


def _given(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _transformed(batches: Iterator[pa.RecordBatch], seed: int, rate: int, spm: int, unit: str, end: str, span: int) -> Iterator[pa.RecordBatch]:
    units = Units(unit, end, span)
    for batch in batches:
        out, held = [], 0
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = value.as_py() or ""
            if held > GIVEN_CHARS:
                yield _given(out)
                out, held = [], 0
            held += len(text)
            digits = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
            h1, h2, h3, h4 = (int(digits[k : k + 8], 16) for k in (0, 8, 16, 24))
            ends = units.ends(text)
            n = len(ends)
            if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
                out.append((key, n, "plain", None, None, text))
                continue
            p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = ends[p - 1] if p else 0, ends[q - 1] if q else 0
            head, middle, tail = text[:a], text[a:b], text[b:]
            if h4 % 100 < spm:
                out.append((key, n, "spm", a, b - a, f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{middle}"))
            else:
                out.append((key, n, "psm", a, b - a, f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{middle}"))
        yield _given(out)


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, unit: str = LINES, end: str = "\n", span: int = SPAN) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the transformed text (``output``) of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(lambda it: _transformed(it, seed, rate, spm, unit, end, span), kind)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. Parts hold no sentinel, and none arises where parts meet."""

    def part(column: Column, mark: str, k: int) -> Column:
        return F.split_part(column, F.lit(mark), F.lit(k))

    last = part(output, MIDDLE, 2)
    first = part(output, MIDDLE, 1)  # both other parts, each behind its sentinel
    psm = F.concat(part(part(first, SUFFIX, 1), PREFIX, 2), last, part(first, SUFFIX, 2))
    spm = F.concat(part(first, PREFIX, 2), last, part(part(first, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
