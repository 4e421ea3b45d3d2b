"""Units returned by year and month: the series and its 12-slot pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rmalytics.functions.dates import month_number
from rmalytics.schemas import MONTHS

SLOTS = tuple(m.lower() for m in MONTHS)


def returns_by_year_month(returns: DataFrame) -> DataFrame:
    """(year, month, total_return_quantity) in calendar order; an unknown
    month name keeps its row and sorts first (month number 0)."""
    agg = (returns.groupBy("year", "month")
           .agg(F.sum("return_quantity").cast("bigint").alias("total_return_quantity")))
    return agg.orderBy("year", month_number(F.col("month")), "month")


def monthly_pivot(returns: DataFrame) -> DataFrame:
    """One row per year, twelve month slots (0 when empty) and their total.

    A single partial/final aggregate with twelve conditional sums: one small
    shuffle of at most (#partitions x #years) rows. Unknown month names add
    to no slot, but their year still gets a row.
    """
    slot = [F.coalesce(F.sum(F.when(F.col("month") == m, F.col("return_quantity"))), F.lit(0))
            .cast("bigint").alias(s) for m, s in zip(MONTHS, SLOTS)]
    piv = returns.groupBy("year").agg(*slot)
    total = sum((F.col(s) for s in SLOTS[1:]), F.col(SLOTS[0])).alias("total")
    return piv.select("year", *SLOTS, total).orderBy("year")


def yearly_total(returns: DataFrame) -> DataFrame:
    """Sum of the twelve slots per year (units in unknown months excluded)."""
    known = F.col("month").isin(*MONTHS)
    return (returns.groupBy("year")
            .agg(F.coalesce(F.sum(F.when(known, F.col("return_quantity"))), F.lit(0))
                 .cast("bigint").alias("total"))
            .orderBy("year"))


def year_series(spark: SparkSession, returns: DataFrame, years: list[int]) -> DataFrame:
    """The pivot for the requested years only; a year without data gives
    twelve zeros. The pivot is computed for those years only (partition
    pruning), and the requested list is a handful of literals."""
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(int(y)) for y in years]).cast("array<int>")).alias("year"))
    piv = monthly_pivot(returns.filter(F.col("year").isin(*[int(y) for y in years])))
    out = wanted.join(piv, "year", "left").na.fill(0, subset=[*SLOTS, "total"])
    return out.select("year", *SLOTS, "total").orderBy("year")
