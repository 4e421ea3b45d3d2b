"""Grouping keys under the source database's text equality.

The source tables compare text without regard to letter case or accents:
'abc', 'ABC' and 'ábc' are one SKU. Operators therefore group and join on
folded keys and show one spelling per key, the smallest in binary order.
Folding strips accents from the Latin letters (U+00C0 to U+024F) whose
Unicode decomposition is a base letter plus combining marks, lower-cases,
and applies the collation's equalities for letters Unicode does not
decompose (below). ``fold_case=False`` in the operators compares text
exactly, which keeps every aggregate a plain HashAggregate.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from Unicode NFD."""
    src, dst = [], []
    for cp in range(0xC0, 0x250):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and d[0].isascii() and d[0].isalpha() \
                and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            src.append(chr(cp))
            dst.append(d[0])
    return "".join(src), "".join(dst)


# --- fixed values: equalities of the source collation (utf8mb4_0900_ai_ci) for
# letters without a Unicode decomposition; applied after lower-casing ---
COLLATION_LETTERS = (("ø", "o"), ("đ", "d"), ("ħ", "h"), ("ł", "l"), ("ŧ", "t"))
COLLATION_EXPANSIONS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ĳ", "ij"))

ACCENTED, UNACCENTED = _accent_table()
_UNACCENT = str.maketrans(ACCENTED, UNACCENTED)


def fold(c: Column) -> Column:
    """Text -> its comparison key: accents stripped, lower case, the
    collation's letter equalities applied."""
    k = F.lower(F.translate(c, ACCENTED, UNACCENTED))
    k = F.translate(k, "".join(a for a, _ in COLLATION_LETTERS), "".join(b for _, b in COLLATION_LETTERS))
    for a, b in COLLATION_EXPANSIONS:
        k = F.replace(k, F.lit(a), F.lit(b))
    return k


def fold_text(s: str) -> str:
    """The same fold for a Python string (search patterns)."""
    k = s.translate(_UNACCENT).lower()
    for a, b in COLLATION_LETTERS + COLLATION_EXPANSIONS:
        k = k.replace(a, b)
    return k


# Folded keys that the stored tables carry beside the text, made at ingest.
STORED_KEYS = {"asin": "asin_key", "merchant_sku": "sku_key", "return_reason": "reason_key"}


def with_stored_keys(df: DataFrame) -> DataFrame:
    """Adds the folded key of each text column that tables keep one for."""
    return df.withColumns({key: fold(F.col(c)) for c, key in STORED_KEYS.items() if c in df.columns})


def without_stored_keys(df: DataFrame) -> DataFrame:
    """For frames whose texts are changed: keys are folded anew where needed."""
    return df.drop(*STORED_KEYS.values())


def folded(df: DataFrame, name: str) -> Column:
    """The folded key of column ``name``: the stored one if ``df`` has it."""
    key = STORED_KEYS.get(name)
    return F.col(key) if key in df.columns else fold(F.col(name))


def key_of(df: DataFrame, name: str, fold_case: bool) -> Column:
    """The grouping key of column ``name`` of ``df``."""
    return folded(df, name) if fold_case else F.col(name)


def spelling(name: str) -> Column:
    """The displayed spelling of a folded group: the smallest distinct value.

    ``collect_set`` keeps only the distinct spellings of one key (a handful),
    so the buffer stays small whatever the group's row count.
    """
    return F.array_min(F.collect_set(F.col(name)))


def key_name(name: str) -> str:
    return f"{name}_key"


def keyed_sums(df: DataFrame, cols: list[str], sums: dict[str, Column], fold_case: bool) -> DataFrame:
    """Group ``df`` by ``cols`` under the text equality and add up ``sums``.

    Returns ``<col>_key`` and ``<col>`` (the displayed spelling) for every
    column, plus one column per sum.

    Exact: one HashAggregate. Folded: the raw rows first go through a
    HashAggregate on (key, spelling) pairs, which string grouping keys do not
    prevent; the spelling aggregate (``collect_set``, an ObjectHashAggregate)
    then only sees one row per distinct spelling per key, never the raw rows.
    """
    pairs = keyed_pairs(df, cols, sums, fold_case)
    if not fold_case:
        return pairs
    return pairs.groupBy(*[key_name(c) for c in cols]).agg(
        *[spelling(c).alias(c) for c in cols], *[F.sum(n).cast("bigint").alias(n) for n in sums])


def keyed_pairs(df: DataFrame, cols: list[str], sums: dict[str, Column], fold_case: bool) -> DataFrame:
    """The first step of ``keyed_sums``: ``sums`` for each key and spelling."""
    named = {n: F.sum(e).alias(n) for n, e in sums.items()}
    if not fold_case:
        out = df.groupBy(*cols).agg(*named.values()) if named else df.select(*cols).distinct()
        return out.select(*[F.col(c).alias(key_name(c)) for c in cols], "*")
    keyed = df.select(*[folded(df, c).alias(key_name(c)) for c in cols], *cols,
                      *[e.alias(n) for n, e in sums.items()])
    return keyed.groupBy(*[key_name(c) for c in cols], *cols).agg(
        *[F.sum(n).alias(n) for n in sums]) if sums else \
        keyed.select(*[key_name(c) for c in cols], *cols).distinct()
