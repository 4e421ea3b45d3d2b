"""Return rates, rate bands and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def return_rate(returns: Column, sold: Column, rounding: str = "half_even",
                zero_when_no_sales: bool = False) -> Column:
    """``returns / sold * 100`` rounded to 2 decimals, as double.

    The quotient is exact decimal arithmetic (decimal(38,18)), so ties are
    real ties. ``rounding``: 'half_up' (SQL ROUND on exact numbers) or
    'half_even' (Python's round on decimals). No sales (0 or NULL) gives NULL,
    or 0 with ``zero_when_no_sales``.
    """
    num = returns.cast("decimal(20,0)") * F.lit(100)
    den = F.nullif(sold.cast("decimal(20,0)"), F.lit(0))
    q = num / den
    if rounding == "half_up":
        r = F.round(q, 2)
    elif rounding == "half_even":
        r = F.bround(q, 2)
    else:
        raise ValueError(f"rounding must be 'half_up' or 'half_even', not {rounding!r}")
    r = r.cast("double")
    return F.coalesce(r, F.lit(0.0)) if zero_when_no_sales else r


def rate_band(rate: Column) -> Column:
    """> 10 -> 'danger', > 5 -> 'warning', else (and NULL) 'none'."""
    return F.when(rate > 10, "danger").when(rate > 5, "warning").otherwise("none")


def has_returns(returns: Column) -> Column:
    return F.coalesce(returns > 0, F.lit(False))
