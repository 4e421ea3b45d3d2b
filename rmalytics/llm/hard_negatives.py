"""Hard negatives by rotated one-bit codes with deterministic intervals.

Vectors of whole numbers are rotated by a seeded randomised Hadamard transform,
which changes no inner product. Of a rotated unit vector u only its signs are
kept, as bits, with the alignment a = <u, c>, where c is the unit vector of
those signs. A rotated unit query w is rounded to ``PLANES`` bits a dimension,
so that <w', c> is a sum of popcounts of the code under the query's bit planes,
one for each place, and what rounding leaves, |w - w'|, is known. As
u = a c + r with r at right angles to c and |r|^2 = 1 - a^2, Cauchy-Schwarz
gives for s = <w, c>, which is within |w - w'| of <w', c>,

    |<w, u> - a s| <= sqrt(1 - s^2) sqrt(1 - a^2).

This holds for every vector, with no chance of error. A candidate whose
interval can't reach the best scores (or the band asked for) is left out; those
whose interval can are scored with whole numbers.

Two searches are made over the table, each one job however many anchors there
are: the anchors' best rows of the same label, then, for every anchor and
positive, the best rows of other labels whose score lies in the positive's
band. Anchors are a stated set of rows and lie in files of at most ``block``
rows; a task takes its rows in chunks of bounded size, codes them once and meets
the anchors' files one after the other. It returns at most k rows for a search,
which a window over the searches merges. Labels share no task, so a frequent
label is no heavier than others.

Edge cases: rows whose label, vector or id is null, whose vector is empty or
holds a null, NaN or infinite component take no part; only vectors of equal length are
compared; a zero vector scores 0 with all; rows with the anchor's id are not its
positives; repeated rows count each, and repeated anchors give their rows each;
ties go to smaller ids; an empty table gives no rows; other columns, clashing
ones included, are left out. Scores beyond what a float64 holds exactly are
computed as Python integers, and held at the ends of long in the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rmalytics.llm._files import open_fs
from rmalytics.session import scratch_path

ANCHOR_BLOCK = 1024
CHUNK_ELEMENTS = 1 << 22
PLANES = 8
EXACT = float(1 << 52)
LOW, HIGH = -(1 << 63), (1 << 63) - 1
_SLACK = 1e-9


class Rotation:
    """Random signs and a Hadamard transform, three times, over the next power of two dimensions."""

    def __init__(self, dims: int, seed: int):
        self.dims, self.wide = dims, 1 << max(0, dims - 1).bit_length()
        self.signs = np.random.default_rng([seed, dims]).choice([-1.0, 1.0], size=(3, self.wide))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.wide))
        out[:, : self.dims] = x
        for signs in self.signs:
            out *= signs
            half = 1
            while half < self.wide:
                pairs = out.reshape(len(x), -1, 2, half)
                out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), self.wide)
                half *= 2
            out /= math.sqrt(self.wide)
        return out


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(flags, axis=1)
    room = np.zeros((len(flags), -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
    room[:, : packed.shape[1]] = packed
    return room.view(np.uint64)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and their lengths; rows of zeros stay zero."""
    top = np.abs(x).max(axis=1, initial=0.0)
    safe = np.where(top > 0, top, 1.0)
    x = x / safe[:, None]
    norm = np.sqrt((x * x).sum(axis=1))
    with np.errstate(over="ignore"):
        return x / np.where(norm > 0, norm, 1.0)[:, None], norm * top


class Codes:
    """One-bit codes of rows, with their alignments and lengths."""

    def __init__(self, vectors: np.ndarray, rotation: Rotation):
        unit, self.norm = _unit(vectors)
        turned = rotation(unit)
        signs = turned >= 0
        self.bits = _bits(signs)
        self.ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.align = np.abs(turned).sum(axis=1) / math.sqrt(rotation.wide)
        self.rest = np.sqrt(np.maximum(0.0, 1.0 - self.align**2)) + _SLACK


class Queries:
    """Unit queries, rotated and rounded to bit planes."""

    def __init__(self, vectors: np.ndarray, rotation: Rotation, planes: int = PLANES):
        unit, self.norm = _unit(vectors)
        turned = rotation(unit)
        self.root = math.sqrt(rotation.wide)
        self.base = turned.min(axis=1, initial=0.0)
        self.step = np.maximum((turned.max(axis=1, initial=0.0) - self.base) / ((1 << planes) - 1), 1e-300)
        level = np.clip(np.rint((turned - self.base[:, None]) / self.step[:, None]), 0, (1 << planes) - 1).astype(np.int64)
        self.planes = [_bits((level >> b) & 1 == 1) for b in range(planes)]
        rounded = self.base[:, None] + level * self.step[:, None]
        self.total = rounded.sum(axis=1)
        self.off = np.sqrt(((turned - rounded) ** 2).sum(axis=1)) + _SLACK

    def intervals(self, k: int, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of query k's cosine with each coded row, from popcounts."""
        raised = np.zeros(len(codes.bits), dtype=np.int64)
        for b, plane in enumerate(self.planes):
            raised += np.bitwise_count(codes.bits & plane[k]).sum(axis=1, dtype=np.int64) << b
        # sum of w' over the set bits, less that over the others
        positive = self.base[k] * codes.ones + self.step[k] * raised
        s = (2 * positive - self.total[k]) / self.root
        least = np.maximum(0.0, np.abs(s) - self.off[k])
        wide = codes.align * self.off[k] + np.sqrt(np.maximum(0.0, 1.0 - least * least)) * codes.rest + _SLACK
        middle = codes.align * s
        return middle - wide, middle + wide


def _scaled_integers(x: np.ndarray, scale: float) -> list[int]:
    """floor(scale * x) as Python integers (``scale`` is a power of two, so the product is exact)."""
    return [math.floor(v * scale) if abs(v) < 1e290 else int(v) * int(scale) for v in x.tolist()]


def _whole(raw: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x), and which rows leave float64: these stay as they are, and get no bounds."""
    with np.errstate(over="ignore"):
        whole = np.floor(raw * scale)
    huge = ~np.isfinite(whole).all(axis=1)
    whole[huge] = raw[huge]
    return whole, huge


class Chunk:
    """Rows of one length: raw vectors, whole numbers and codes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, raw: np.ndarray, rotation: Rotation, scale: float):
        self.ids, self.labels, self.raw, self.scale = ids, labels, raw, scale
        self.whole, huge = _whole(raw, scale)
        self.codes = Codes(self.whole, rotation)
        self.codes.norm[huge] = np.inf

    def scores(self, block: AnchorBlock, k: int, rows: np.ndarray) -> np.ndarray:
        """Integer scores of ``rows`` with the block's anchor k; Python integers where float64 may round."""
        with np.errstate(invalid="ignore", over="ignore"):
            exact = block.codes.norm[k] * self.codes.norm[rows].max(initial=0.0) < EXACT
        if exact:
            few = len(rows) * 2 < len(self.whole)
            return self.whole[rows] @ block.whole[k] if few else (self.whole @ block.whole[k])[rows]
        q = _scaled_integers(block.raw[k], self.scale)
        return np.array([sum(a * b for a, b in zip(q, _scaled_integers(self.raw[r], self.scale), strict=True)) for r in rows.tolist()], dtype=object)


class AnchorBlock:
    """Anchors of one length: raw vectors, whole numbers, rounded rotated queries and bands."""

    def __init__(self, rows: pd.DataFrame, rotation: Rotation, scale: float):
        self.block, self.at = rows["block"].to_numpy(), rows["at"].to_numpy()
        self.ids, self.labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.raw = np.stack([np.asarray(v, dtype=np.float64) for v in rows["v"]])
        self.whole, huge = _whole(self.raw, scale)
        self.codes = Queries(self.whole, rotation)
        self.codes.norm[huge] = np.inf
        self.bands = rows["bands"].tolist() if "bands" in rows else None


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k], dtype=np.int64)
    return np.lexsort((ids, -scores))[:k]


def _reaching(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Rows whose upper bound reaches the k-th best lower bound."""
    if len(low) <= k:
        return np.arange(len(low))
    return np.flatnonzero(high >= np.partition(low, len(low) - k)[len(low) - k])


def search(chunk: Chunk, block: AnchorBlock, k: int, most: int, same: bool) -> Iterator[tuple[int, int, int]]:
    """(search number, id, score) of the best rows for the block's anchor k.

    With ``same`` there is one search, over the other rows of its label; else
    one for each of its bands (lowest and highest score), over other labels.
    """
    mine = chunk.labels == block.labels[k]
    rows = np.flatnonzero(mine & (chunk.ids != block.ids[k])) if same else np.flatnonzero(~mine)
    if not len(rows):
        return
    low, high = block.codes.intervals(k, chunk.codes)
    length = block.codes.norm[k] * chunk.codes.norm[rows]
    with np.errstate(over="ignore", invalid="ignore"):
        edge = 1e-9 * length + 1.0
        low, high = low[rows] * length - edge, high[rows] * length + edge
    low, high = np.nan_to_num(low, nan=-np.inf, neginf=-np.inf), np.nan_to_num(high, nan=np.inf, posinf=np.inf)
    if same:
        rows = rows[_reaching(low, high, most)]
        scores = chunk.scores(block, k, rows)
        for j in _best(scores, chunk.ids[rows], most):
            yield 0, int(chunk.ids[rows[j]]), int(scores[j])
        return
    bands = block.bands[k]
    within = np.zeros(len(rows), dtype=bool)
    for a, b in bands:
        near = np.flatnonzero((high >= a) & (low <= b))
        # rows surely inside the band outrank those that can't reach them
        sure = near[(low[near] >= a) & (high[near] <= b)]
        if len(sure) >= most:
            near = near[high[near] >= np.partition(low[sure], len(sure) - most)[len(sure) - most]]
        within[near] = True
    rows = rows[within]
    if not len(rows):
        return
    scores, ids = chunk.scores(block, k, rows), chunk.ids[rows]
    for number, (a, b) in enumerate(bands):
        inside = np.flatnonzero((scores >= a) & (scores <= b))
        for j in inside[_best(scores[inside], ids[inside], most)]:
            yield number, int(ids[j]), int(scores[j])


def band(score: int, least: int, most: int, unit: int) -> tuple[int, int]:
    """Lowest and highest whole scores with least * score <= unit * x <= most * score."""
    return -(-least * score // unit), most * score // unit


def _taken(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of runs of rows of one length, of about ``limit`` components."""
    waiting: dict[int, list] = {}
    held: dict[int, int] = {}
    for batch in batches:
        size = np.asarray(batch.column(2).value_lengths())
        flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        start = np.cumsum(size) - size
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        for d in np.unique(size).tolist():
            every = np.flatnonzero(size == d)
            step = max(1, limit // d)
            for a in range(0, len(every), step):
                rows = every[a : a + step]
                waiting.setdefault(d, []).append((ids[rows], labels[rows], flat[start[rows][:, None] + np.arange(d)]))
                held[d] = held.get(d, 0) + len(rows) * d
                if sum(held.values()) >= limit:  # the longest run goes first
                    d_most = max(held, key=held.get)
                    del held[d_most]
                    yield tuple(np.concatenate(c) for c in zip(*waiting.pop(d_most), strict=True))
    for runs in waiting.values():
        yield tuple(np.concatenate(c) for c in zip(*runs, strict=True))


def _search_all(table: DataFrame, files: list[str], most: int, same: bool, seed: int, scale: float, chunk_elements: int, bands: tuple[int, int, int]) -> DataFrame:
    """block, at, search, id, score: each chunk's best for every anchor in ``files``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations: dict[int, Rotation] = {}
        for ids, labels, raw in _taken(batches, chunk_elements):
            d = raw.shape[1]
            rotation = rotations.setdefault(d, Rotation(d, seed))
            chunk = Chunk(ids, labels, raw, rotation, scale)
            for file in files:
                system, path = open_fs(file)
                with system.open_input_file(path) as f:
                    anchors = pq.ParquetFile(f).read().to_pandas()  # at most ``block`` rows
                anchors = anchors[anchors["v"].map(len) == d]
                if not len(anchors):
                    continue
                if not same:
                    anchors["bands"] = [[band(int(s), *bands) for s in scores] for scores in anchors["scores"]]
                block = AnchorBlock(anchors, rotation, scale)
                found = [(int(block.block[k]), int(block.at[k]), *x) for k in range(len(block.at)) for x in search(chunk, block, k, most, same)]
                columns = list(zip(*found, strict=True)) if found else [[]] * 5
                columns[4] = [min(max(s, LOW), HIGH) for s in columns[4]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["block", "at", "search", "id", "score"])

    return table.mapInArrow(run, "block long, at long, search long, id long, score long")


def hard_negatives(
    spark: SparkSession,
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    unit: int = 100,
    scale: float = 256.0,
    seed: int = 13,
    block: int = ANCHOR_BLOCK,
    chunk_elements: int = CHUNK_ELEMENTS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor and each of its ``positives`` best rows of the same label:
    the ``negatives`` best rows of other labels with
    ``least * positive_score <= unit * negative_score <= most * positive_score``.
    Components are floor(``scale`` * x), with ``scale`` a power of two.
    """
    folder = scratch_path(spark, "negatives")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    own_label = F.col(label) if isinstance(label, str) else label
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & own_label.isNotNull() & (F.size(vector) > 0) & ~bad)
    values = F.transform(vector, lambda x: x.cast("double"))
    anchor = F.coalesce(is_anchor, F.lit(False)).alias("anchor")
    table = rows.select(F.col(id_col).cast("long").alias("id"), own_label.cast("long").alias("label"), values.alias("v"), anchor)
    # anchors in files of at most ``block`` rows: a file is an anchor's block, its place there ``at``
    asked = kept(table.where("anchor").select("id", "label", "v"), "asked")
    n = asked.count()
    table = table.select("id", "label", "v")
    parts = max(1, -(-n // block))
    number = (F.monotonically_increasing_id() / F.lit(block)).cast("long")
    # a partition's rows count from partition << 33, so blocks of two partitions differ
    blocks = asked.repartition(parts).select(number.alias("block"), F.pmod(F.monotonically_increasing_id(), F.lit(block)).alias("at"), "id", "label", "v")
    blocks.write.option("maxRecordsPerFile", block).parquet(f"{folder}/anchors")
    anchors = spark.read.schema(blocks.schema).parquet(f"{folder}/anchors")
    files = sorted(anchors.inputFiles()) if n else []
    bands = (least, most, unit)
    found = kept(_search_all(table, files, positives, True, seed, scale, chunk_elements, bands), "same-label")
    rank = F.row_number().over(W.partitionBy("block", "at").orderBy(F.desc("score"), "id"))
    best = kept(found.select("block", "at", "id", "score", rank.alias("place")).where(F.col("place") <= positives).withColumnRenamed("id", "positive_id"), "positives")

    # the anchors again, with their positives' scores in order, one file a block
    listed = best.groupBy("block", "at").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("p"))
    again = anchors.join(listed, ["block", "at"]).select("block", "at", "id", "label", "v", F.col("p.score").alias("scores"))
    again.repartition(parts, "block").write.option("maxRecordsPerFile", block).parquet(f"{folder}/bands")
    files = sorted(spark.read.schema(again.schema).parquet(f"{folder}/bands").inputFiles()) if n else []
    found = kept(_search_all(table, files, negatives, False, seed, scale, chunk_elements, bands), "other-labels")
    rank = F.row_number().over(W.partitionBy("block", "at", "search").orderBy(F.desc("score"), "id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    out = ranked.join(best.select("block", "at", F.col("place").cast("long").alias("p"), "positive_id", F.col("score").alias("positive_score")).withColumn("search", F.col("p") - 1), ["block", "at", "search"])
    out = out.join(anchors.select("block", "at", F.col("id").alias("anchor_id")), ["block", "at"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
