"""A filter for rows whose key occurs in another frame, before they are shuffled.

A Bloom filter of fixed size, of built-in functions: two bits for each key in
an array of longs, which a scalar subquery gives to the scan of the other
table. No key of the frame is ever left out; of other keys about one in forty
passes with 100,000 keys, more beyond that, so what follows must still join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 14  # of 64 bits: 128 KB
ROW_BITS = 7
ROW = 1 << ROW_BITS


def _bits(key: Column) -> list[Column]:
    """The key's two places."""
    h = F.xxhash64(key)
    return [F.pmod(x, F.lit(WORDS * 64)) for x in (h, F.shiftrightunsigned(h, 32))]


def _gathered(groups, place: Column, value: Column, size: int, none: Column) -> DataFrame:
    """For each group the array ``v`` of its values by place, ``none`` at places without one."""
    entries = groups.agg(F.map_from_entries(F.collect_list(F.struct(place.alias("k"), value.alias("x")))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at(F.col("m"), k), none))
    return entries.withColumn("v", every).drop("m")


def key_filter(keys: Column, frame: DataFrame) -> DataFrame:
    """One row: the filter of ``keys`` over ``frame``, an array of longs."""
    places = frame.select(F.explode(F.array(*_bits(keys))).alias("place"))
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    words = places.groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    # words to rows of the filter, and rows to the filter: only what is set is shuffled
    row, at = F.shiftright("word", ROW_BITS), F.expr(f"word & {ROW - 1}")
    rows = _gathered(words.groupBy(row.alias("row")), at, F.col("bits"), ROW, F.lit(0).cast("long"))
    whole = _gathered(rows.groupBy(), F.col("row"), F.col("v"), WORDS // ROW, F.array_repeat(F.lit(0).cast("long"), ROW))
    return whole.select(F.flatten("v").alias("bits"))


def may_hold(filter_: Column, key: Column) -> Column:
    """Whether the key may be one of the filter's."""
    out = F.lit(True)
    for place in _bits(key):
        word = F.get(filter_, F.shiftright(place, 6).cast("int"))
        out &= F.call_function("getbit", word, F.pmod(place, F.lit(64)).cast("int")) == 1
    return out
