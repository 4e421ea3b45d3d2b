"""Numeric parsing of report fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rmalytics.functions.text import py_strip


def strict_int(c: Column) -> Column:
    """Text -> int like Python ``int()``: surrounding blanks allowed, a sign,
    digits with single '_' between them. Anything else (blank, '1.5', 'x')
    gives NULL; the ingest treats NULL as a rejected row. Nearly all values
    are a few digits alone: they are told by one pattern."""
    s = py_strip(c)
    ok = s.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$")
    digits = F.when(s.contains("_"), F.regexp_replace(s, "_", "")).otherwise(s)
    return F.when(c.rlike(r"^[0-9]{1,9}\z"), c.try_cast("int")).when(ok, digits.try_cast("int"))


def blank_to_zero_float(c: Column) -> Column:
    """Blank (or missing) -> 0.0; a number -> float; anything else -> NULL.
    Plain decimals, nearly all values, are told by one pattern."""
    s = py_strip(F.coalesce(c, F.lit("")))
    num = F.when(s.contains("_"), F.regexp_replace(s, r"(?<=[0-9])_(?=[0-9])", "")).otherwise(s)
    ok = num.rlike(r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$")
    nan = F.lower(num).rlike("^[+-]?nan$")  # Spark's cast takes only an unsigned 'NaN'
    return (F.when(c.rlike(r"^[0-9]+(\.[0-9]+)?\z"), c.try_cast("float"))
            .when(c.isNull() | (c == "") | (s == ""), F.lit(0.0).cast("float"))
            .when(nan, F.lit(float("nan")).cast("float"))
            .when(ok, num.try_cast("float")))


def text_flag(c: Column) -> Column:
    """'true' in any letter case -> true; anything else, blank or NULL -> false."""
    return F.coalesce(F.lower(c) == "true", F.lit(False))
