"""Text helpers: whitespace stripping and LIKE patterns for product search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters Python's str.strip() removes: everything str.isspace() accepts.
PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def py_strip(c: Column) -> Column:
    """Strip leading/trailing whitespace the way Python's ``str.strip`` does.

    Spark's one-argument ``trim`` removes only ASCII blanks, so tabs and
    no-break spaces would survive it; ``btrim`` with the character set is a
    plain scan, no regex.
    """
    return F.btrim(c, F.lit(PY_WHITESPACE))


def like_pattern(term: str, literal: bool = False) -> str:
    """``%term%`` for a case-insensitive substring search.

    Default: the term is used unescaped, so ``%`` and ``_`` typed by the user
    stay wildcards (as in the source application). A backslash before an
    ordinary character is dropped (``\\b`` means ``b``), which Spark would
    otherwise reject. ``literal=True`` escapes ``%``, ``_`` and ``\\``.
    """
    out = []
    i = 0
    while i < len(term):
        ch = term[i]
        if literal:
            out.append("\\" + ch if ch in "%_\\" else ch)
        elif ch == "\\":
            nxt = term[i + 1] if i + 1 < len(term) else None
            if nxt is None:
                out.append("\\\\")
            elif nxt in "%_\\":
                out.append("\\" + nxt)
                i += 1
            else:
                out.append(nxt)
                i += 1
        else:
            out.append(ch)
        i += 1
    return "%" + "".join(out) + "%"


def matches(df: DataFrame, term: str, *cols: str, literal: bool = False) -> Column:
    """OR of ``LIKE '%term%'`` over ``cols`` of ``df``, ignoring letter case and
    accents as the source database's collation does (on stored keys if any)."""
    from rmalytics.functions.keys import fold_text, folded

    pattern = fold_text(like_pattern(term, literal))
    cond = None
    for c in cols:
        one = folded(df, c).like(pattern)
        cond = one if cond is None else (cond | one)
    return F.coalesce(cond, F.lit(False))
