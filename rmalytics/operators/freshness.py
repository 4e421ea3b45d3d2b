"""Data freshness: when the returns table was last loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rmalytics.functions.dates import us_date_text


def freshness(returns: DataFrame) -> DataFrame:
    """One row: last_updated (NULL for an empty table) and its MM-DD-YYYY text."""
    m = returns.agg(F.max("last_updated").alias("last_updated"))
    return m.select("last_updated", us_date_text(F.col("last_updated")).alias("last_updated_text"))
