"""Exact top-k by inner product: columnar branch and bound.

A batch of vectors is laid out dimension by dimension. For each query the
scores are built up over blocks of dimensions, those with the queries' most
mass first; after each block a candidate can at most gain the product of the
norms that query and candidate have left (Cauchy-Schwarz), and those that can't
reach the task's k-th best score any more are compacted away. What is left after
the last block has its exact integer score.

Queries are a stated set of rows, which grows with the table: they are written
in files of at most ``block`` rows, and each file in turn is broadcast to one
scan of the table (``block`` vectors is the size bound). Tasks return k rows
for each query; those are merged by a window over the queries.

Edge cases: vectors that are null, empty or hold null, NaN or infinite
components take no part, nor do rows without id; only vectors of equal length
are compared; rows with the query's id are not its candidates; repeated query
rows give their results each; other columns are left out. Scores beyond the
range of long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rmalytics.session import scratch_path

QUERY_BLOCK = 1024
DIMS = 8
EXACT = float(1 << 53)


def _order(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Block:
    """Queries of one length, and the best found so far for each."""

    def __init__(self, at: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.at, self.ids, self.k = at, ids, k
        self.perm = np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.q = np.ascontiguousarray(vectors[:, self.perm], dtype=np.float64)
        self.most = float(np.abs(self.q).max(initial=0))
        self.left = self._left(self.q.T)
        self.best = [(np.empty(0), np.empty(0, np.int64)) for _ in at]

    def _left(self, columns: np.ndarray) -> np.ndarray:
        """Norm of the dimensions from each block on, by block."""
        d = len(columns)
        squares = np.zeros((-(-d // DIMS) + 1, columns.shape[1]))
        for b in range(len(squares) - 2, -1, -1):
            squares[b] = squares[b + 1] + (columns[b * DIMS : (b + 1) * DIMS] ** 2).sum(axis=0)
        return np.sqrt(squares)

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Takes the rows of ``vectors`` (row by row, float64 with whole values) as candidates."""
        d = vectors.shape[1]
        if self.most * float(np.abs(vectors).max(initial=0)) * d >= EXACT:
            return self._search_wide(ids, vectors)
        x = np.ascontiguousarray(vectors[:, self.perm].T)
        left = self._left(x)
        for k, q in enumerate(self.q):
            scores, own = self.best[k]
            rows = np.flatnonzero(ids != self.ids[k])
            if len(scores) < self.k:  # a first threshold
                first, rows = rows[: 8 * self.k], rows[8 * self.k :]
                scores, own = self._merge(scores, own, q @ x[:, first], ids[first])
            acc, alive = np.zeros(len(rows)), rows
            for b in range(len(left) - 1):
                if not len(alive):
                    break
                part = x[b * DIMS : (b + 1) * DIMS]
                acc = acc + q[b * DIMS : (b + 1) * DIMS] @ (part if len(alive) == x.shape[1] else part[:, alive])
                if len(scores) == self.k:
                    reach = acc + self.left[b + 1, k] * left[b + 1, alive] * (1 + 1e-9) + 1e-6
                    keep = reach >= scores[-1]
                    acc, alive = acc[keep], alive[keep]
            self.best[k] = self._merge(scores, own, acc, ids[alive])

    def _merge(self, scores, own, more, ids):
        scores, own = np.concatenate([scores, more]), np.concatenate([own, ids])
        o = _order(scores, own, self.k)
        return scores[o], own[o]

    def _search_wide(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Products beyond float64's whole numbers, in Python integers."""
        whole = [[int(v) for v in row] for row in vectors[:, self.perm]]
        for k, q in enumerate(self.q):
            q = [int(v) for v in q]
            got = [(sum(a * b for a, b in zip(q, row, strict=True)), int(i)) for i, row in zip(ids, whole, strict=True) if i != self.ids[k]]
            old = [(int(s), int(i)) for s, i in zip(*self.best[k], strict=True)]
            top = sorted(old + got, key=lambda p: (-p[0], p[1]))[: self.k]
            self.best[k] = (np.array([p[0] for p in top], dtype=object), np.array([p[1] for p in top], dtype=np.int64))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the list column."""
    size = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(size) - size
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[start[rows][:, None] + np.arange(d)]


def top_k(spark: SparkSession, df: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best rows, ties to smaller ids."""
    folder = scratch_path(spark, "topk")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & (F.size(vector) > 0) & ~bad)
    # whole values, as double: floor to long would overflow on huge components
    whole = F.transform(vector, lambda x: x.cast("double") * F.lit(scale))
    queries = rows.where(is_query).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    queries.write.parquet(f"{folder}/all")
    n = (queries := spark.read.parquet(f"{folder}/all")).count()
    queries.repartition(max(1, -(-n // block))).write.option("maxRecordsPerFile", block).parquet(f"{folder}/queries")
    table = rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    kind = "block long, at long, query_id long, vec_id long, score long"
    parts = sorted(spark.read.schema("id long, v array<double>").parquet(f"{folder}/queries").inputFiles()) if n else []
    spark.createDataFrame([], kind).write.parquet(f"{folder}/top")
    for number, part in enumerate(parts):
        own = spark.read.parquet(part).toPandas()  # at most ``block`` rows

        def search(batches: Iterator[pa.RecordBatch], own=own, number=number) -> Iterator[pa.RecordBatch]:
            blocks: dict[int, Block] = {}
            ids = own["id"].to_numpy(dtype=np.int64)
            sizes = own["v"].map(len).to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                blocks[int(d)] = Block(at, ids[at], np.floor(np.stack([np.asarray(v, dtype=np.float64) for v in own["v"].iloc[at]])), k)
            for batch in batches:
                own_ids = batch.column(0).to_numpy(zero_copy_only=False)
                for at, matrix in _vectors(batch.column(1)):
                    if matrix.shape[1] in blocks:
                        blocks[matrix.shape[1]].search(own_ids[at], np.floor(matrix))
            low, high = -(1 << 63), (1 << 63) - 1
            found = [(number, int(b.at[q]), int(b.ids[q]), int(i), min(max(int(s), low), high)) for b in blocks.values() for q in range(len(b.at)) for s, i in zip(*b.best[q], strict=True)]
            names = ["block", "at", "query_id", "vec_id", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 5)], names)

        table.mapInArrow(search, kind).write.mode("append").parquet(f"{folder}/top")
    top = spark.read.schema(kind).parquet(f"{folder}/top")
    rank = F.row_number().over(W.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id"))
    return top.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
