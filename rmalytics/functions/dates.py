"""Date expressions: report dates -> (month name, year), month windows."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from rmalytics.functions.numbers import strict_int
from rmalytics.functions.text import py_strip
from rmalytics.schemas import MONTHS


def month_number(name: Column) -> Column:
    """English month name -> 1..12; anything else -> 0 (exact spelling)."""
    lookup = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(i))])
    return F.coalesce(F.try_element_at(lookup, name), F.lit(0))


def month_name(number: Column) -> Column:
    """1..12 -> English month name; NULL stays NULL."""
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), number - 1)


def report_month_year(c: Column) -> tuple[Column, Column, Column]:
    """Returns-report request date ``D-Mon-YY`` / ``D-Mon-YYYY`` -> (month, year, month number).

    The text is stripped and split on '-'; exactly three parts are required.
    The day part is not checked. The month abbreviation is matched without
    regard to case. Years below 100 get 2000 added. Invalid input gives
    NULLs (the ingest turns that into a rejected row).
    """
    parts = F.split(py_strip(c), "-")
    lookup = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m[:3].lower()), F.lit(i))])
    number = F.try_element_at(lookup, F.lower(F.get(parts, 1)))
    year = strict_int(F.get(parts, 2))  # Python int(): blanks, '+', '_' between digits
    year = F.when(year < 100, year + 2000).otherwise(year)
    valid = (F.size(parts) == 3) & number.isNotNull() & year.isNotNull()
    return (month_name(F.when(valid, number)), F.when(valid, year), F.when(valid, number))


# Text Python's datetime.strptime(s, '%Y-%m-%dT%H:%M:%S%z') accepts (seconds 60-61
# pass its pattern but fail the datetime itself, so they are left out).
_ISO_OFFSET = (
    r"^\d{4}-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])"
    r"T(2[0-3]|[0-1]\d|\d):([0-5]\d|\d):([0-5]\d|\d)"
    r"(Z|[+-]\d\d:?[0-5]\d(:?[0-5]\d(\.\d{1,6})?)?)$"
)


def purchase_month_year(c: Column) -> tuple[Column, Column, Column]:
    """Sales purchase date ``YYYY-MM-DDTHH:MM:SS+hh:mm`` -> (month, year, month number).

    Month and year are those of the written wall clock, not of UTC: the
    offset is validated but not applied. The calendar date must exist.
    """
    date_part = F.substring_index(c, "T", 1)
    y = F.substring_index(date_part, "-", 1)
    m = F.substring_index(F.substring_index(date_part, "-", 2), "-", -1)
    d = F.trim(F.substring_index(date_part, "-", -1))
    day = F.when(c.rlike(_ISO_OFFSET), F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-M-d"))
    return (month_name(F.month(day)), F.year(day), F.month(day))


def _as_date(d) -> _dt.date:
    if isinstance(d, _dt.datetime):
        return d.date()
    if isinstance(d, _dt.date):
        return d
    return _dt.datetime.fromisoformat(str(d)).date()  # the whole text, or ValueError


def month_window_filter(start, end, year: str = "year", month_no: str = "month_no") -> Column:
    """Rows whose month's first day lies in [start, end] (both included).

    Written as plain comparisons on ``year``/``month_no`` so that the year
    bounds prune partitions and the month bounds reach the Parquet reader.
    """
    s, e = _as_date(start), _as_date(end)
    # first month whose 1st day is >= start; last month whose 1st day is <= end
    sy, sm = (s.year, s.month) if s.day == 1 else (
        (s.year + 1, 1) if s.month == 12 else (s.year, s.month + 1))
    ey, em = e.year, e.month
    if (sy, sm) > (ey, em):
        return F.lit(False)
    y, m = F.col(year), F.col(month_no)
    lo = (y > sy) | ((y == sy) & (m >= sm))
    hi = (y < ey) | ((y == ey) & (m <= em))
    return y.between(sy, ey) & m.between(1, 12) & lo & hi


def us_date_text(ts: Column) -> Column:
    """Timestamp -> ``MM-DD-YYYY`` text."""
    return F.date_format(ts, "MM-dd-yyyy")
