"""`returns` and `sales` derived from the TPC-H-style driver tables.

The domain has no driver table of its own, so the two stored tables are
derived: a returned line item is a return (4 SKUs per ASIN), every line item
is a sale dated by its order.

returns: lineitem(l_returnflag='R') JOIN orders JOIN part
sales:   lineitem JOIN orders
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A task joins, sorts and writes about as many line items, however many there are.
ROWS_PER_TASK = 2_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def asin_of(partkey) -> F.Column:
    return F.concat(F.lit("B"), F.lpad(F.floor(partkey / 4).cast("string"), 9, "0"))


def _spread(spark: SparkSession, sf_dir: str):
    """(frame, key) -> the frame by a hash of the key, in tasks of ``ROWS_PER_TASK``
    line items; as it is while the session's parallelism has no larger ones."""
    tasks = ceil(_table(spark, sf_dir, "lineitem").count() / ROWS_PER_TASK)  # from the files' footers
    many = tasks > spark.sparkContext.defaultParallelism
    return lambda df, key: df.repartition(tasks, F.col(key)) if many else df


def returns_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = _spread(spark, sf_dir)
    li = (_table(spark, sf_dir, "lineitem")
          .filter(F.col("l_returnflag") == "R")
          .select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = spread(li, "l_orderkey").join(spread(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = spread(j, "l_partkey").join(spread(part, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(
        asin_of(F.col("l_partkey")).alias("asin"),
        F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("-"),
                 F.col("p_partkey").cast("string")).alias("merchant_sku"),
        F.col("l_quantity").cast("int").alias("return_quantity"),
        F.col("o_orderpriority").alias("return_reason"),
        F.date_format("l_shipdate", "MMMM").alias("month"),
        F.month("l_shipdate").alias("month_no"),
        F.year("l_shipdate").alias("year"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("last_updated"),
    )


def sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    spread = _spread(spark, sf_dir)
    j = spread(li, "l_orderkey").join(spread(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        asin_of(F.col("l_partkey")).alias("asin"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.date_format("o_orderdate", "MMMM").alias("month"),
        F.month("o_orderdate").alias("month_no"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("last_updated"),
    )
