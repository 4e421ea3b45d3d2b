"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rmalytics.session import scratch_path


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b")
    out = moved.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(moved.select(F.col("m").alias("x"), F.col("b").alias("y")))
    return out.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (x, y); label: the component's smallest node.

    Each round is a written table, so lineage stays short and lost executors
    cost one round at most; rounds grow with the logarithm of the nodes.
    """
    folder = scratch_path(spark, "components")
    links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct().write.parquet(f"{folder}/0")
    edges, last, k = spark.read.parquet(f"{folder}/0"), None, 0
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == last or not mark[0]:
            break
        last, k = mark, k + 1
        _small_star(_large_star(edges)).write.parquet(f"{folder}/{k}")
        edges = spark.read.parquet(f"{folder}/{k}")
    roots = edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(roots)
