"""Shards of near equal bytes by Karmarkar-Karp differencing.

Rows with equal texts form a group that stays in one shard. Differencing joins,
again and again, the two partial partitions of largest spread, the one's largest
sum to the other's smallest, until one partition into ``shards`` sums is left.

One heap can't hold all groups of a corpus, so small groups are bundled first:
they are dealt by hash to cells of about ``cell_groups`` groups and each cell is
differenced into ``shards`` bundles, which are the next round's indivisible
items; a round makes ``cell_groups / shards`` items of one. Groups of more than
1 / (``large`` * ``shards``) of all bytes (fewer than ``large * shards``, one
copied text with a third of the bytes among them) are not bundled. The last
round differences at most ``top_items`` items, a number set by parameters.

Slots count from 0 in each shard without gaps: rows are numbered within cells
of (shard, hash of the id) and the cells' counts are summed up.

Edge cases: a null text counts as empty (size 1, crc32 0) and is grouped with
the empty texts; null and repeated ids get slots of their own; an empty table
gives no rows; other columns are left out.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rmalytics.session import scratch_path

CELL_GROUPS = 4096
LARGE = 512
SLOT_CELL = 8192


def differencing(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard (0..shards-1) of each size, by the largest differencing method.

    A partial partition is a list of (sum, members) by falling sum; members are
    chained pairs, so that joining costs no copy. Ties go by first come.
    """
    n = len(sizes)
    out = np.zeros(n, dtype=np.int64)
    if not n:
        return out
    serial = itertools.count()
    heap = [(-int(s), next(serial), [(int(s), k)] + [(0, None)] * (shards - 1)) for k, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = [(x + y, (m, o) if m is not None and o is not None else m if o is None else o) for (x, m), (y, o) in zip(a, reversed(b), strict=True)]
        joined.sort(key=lambda p: -p[0])
        # a common floor needn't be carried: only differences matter to later joins
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], next(serial), joined))
    for shard, (_, members) in enumerate(heap[0][2]):
        todo = [members]
        while todo:
            m = todo.pop()
            if isinstance(m, tuple):
                todo.extend(m)
            elif m is not None:
                out[m] = shard
    return out


def _cell_bundles(shards: int):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["size", "item"], ascending=[False, True])
        part = differencing(cell["size"].to_numpy(), shards)
        return pd.DataFrame({"item": cell["item"], "size": cell["size"], "cell": cell["cell"], "part": part})

    return run


def assign_groups(spark: SparkSession, groups: DataFrame, shards: int, cell_groups: int = CELL_GROUPS, large: int = LARGE) -> DataFrame:
    """item, shard of groups (item string, size long)."""
    top_items = 2 * large * shards
    folder = scratch_path(spark, "shards")
    groups.write.parquet(f"{folder}/items-0")
    items, links, level = spark.read.parquet(f"{folder}/items-0"), [], 0
    total, n = items.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bound = total / (large * shards)
    kept = []  # large items of each round, with the names they have there
    while n > top_items:
        small = items.where(F.col("size") <= bound)
        kept.append(items.where(F.col("size") > bound).select("item", "size"))
        n_small = small.count()
        cells = max(1, -(-n_small // cell_groups))
        dealt = small.withColumn("cell", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(cells)))
        dealt = dealt.groupBy("cell").applyInPandas(_cell_bundles(shards), "item string, size long, cell long, part long")
        name = F.concat_ws(":", F.lit(f"bundle{level}"), "cell", "part").alias("into")
        dealt.select("item", "size", name).write.parquet(f"{folder}/links-{level}")
        link = spark.read.parquet(f"{folder}/links-{level}")
        link.groupBy(F.col("into").alias("item")).agg(F.sum("size").alias("size")).write.parquet(f"{folder}/items-{level + 1}")
        links.append(link.select("item", "into"))
        items, level = spark.read.parquet(f"{folder}/items-{level + 1}"), level + 1
        n = items.count()
    last = items.select("item", "size")
    for k in kept:
        last = last.unionByName(k)
    # at most 2 * large * shards bundles and large * shards large groups for each round
    rows = sorted(((r.size_, r.item) for r in last.withColumnRenamed("size", "size_").collect()), key=lambda r: (-r[0], r[1]))
    part = differencing(np.array([r[0] for r in rows], dtype=np.int64), shards)
    placed = spark.createDataFrame([(r[1], int(p)) for r, p in zip(rows, part, strict=True)], "item string, shard int")
    shard_of = placed
    for link in reversed(links):
        inner = link.join(F.broadcast(shard_of) if link is links[-1] else shard_of, link["into"] == shard_of["item"]).select(link["item"], "shard")
        shard_of = inner.unionByName(placed)
    return shard_of


def shard_rows(spark: SparkSession, df: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", cell_groups: int = CELL_GROUPS, large: int = LARGE, slot_cell: int = SLOT_CELL) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.sha2(body, 256).alias("item"),
    )
    folder = scratch_path(spark, "shard-rows")
    rows.write.parquet(folder)  # what the later steps need of the texts
    rows = spark.read.parquet(folder)
    groups = rows.groupBy("item").agg(F.sum("size").alias("size"))
    # rows of one common text are split by the skew-join rule
    placed = rows.join(assign_groups(spark, groups, shards, cell_groups, large), "item").drop("item")
    placed.write.parquet(f"{folder}-placed")
    placed = spark.read.parquet(f"{folder}-placed")
    cells = max(1, -(-placed.count() // slot_cell))
    # the size and digest beside the id: a repeated id need not meet in one cell unless its rows are equal
    placed = placed.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(cells)))
    counts = placed.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("shard").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("shard", "_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(W.partitionBy("shard", "_cell").orderBy("doc_id", "size", "text_crc32"))
    out = placed.withColumn("_k", number).join(counts, ["shard", "_cell"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_k") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
