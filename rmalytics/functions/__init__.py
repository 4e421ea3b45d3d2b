"""Column-expression helpers (all JVM-side Spark SQL, no Python UDFs)."""

from rmalytics.functions.dates import (
    month_number,
    month_window_filter,
    purchase_month_year,
    report_month_year,
    us_date_text,
)
from rmalytics.functions.display import count_text, pct_text, product_link
from rmalytics.functions.keys import fold, key_of, keyed_sums, spelling
from rmalytics.functions.numbers import blank_to_zero_float, strict_int, text_flag
from rmalytics.functions.rates import (
    has_returns,
    rate_band,
    return_rate,
)
from rmalytics.functions.text import like_pattern, matches, py_strip

__all__ = [
    "blank_to_zero_float",
    "count_text",
    "fold",
    "key_of",
    "keyed_sums",
    "has_returns",
    "like_pattern",
    "matches",
    "pct_text",
    "product_link",
    "month_number",
    "month_window_filter",
    "purchase_month_year",
    "py_strip",
    "rate_band",
    "report_month_year",
    "return_rate",
    "spelling",
    "strict_int",
    "text_flag",
    "us_date_text",
]
