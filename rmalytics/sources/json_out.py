"""Results as JSON text (what a web front end receives)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rmalytics.operators.monthly import SLOTS


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, in a single ``json`` column (stays distributed)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def series_json(pivot: DataFrame) -> DataFrame:
    """The monthly pivot as one JSON object ``{"<year>": [12 numbers], ...}``.

    A global aggregate over the pivot, whose size is the number of years.
    """
    entry = F.struct(F.col("year").cast("string").alias("k"), F.array(*SLOTS).alias("v"))
    m = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    return pivot.agg(F.to_json(m).alias("series_json"))
