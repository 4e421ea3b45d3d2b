"""Token ids on disk: frequency ranks in byte-aligned variable length.

Ids are replaced by their rank in the corpus (0 for the most frequent), so that
most fit one byte; ranks are written least significant byte first in 1 to 4
bytes, and a separate stream of control bytes holds the lengths of four ranks
each. Reading expands the control bytes by a table of their lengths and
gathers the ranks with numpy, without a loop over tokens.

Layout of a file: ``FRVB`` and blocks up to the end. A block: five
little-endian int64 (documents, ids, control bytes, data bytes, 0), the
documents' ids (int64) and a byte each that is 1 for a null id, their numbers
of token ids (int64), control bytes, data bytes. ``ranks.npy`` beside the files
has the token id of each rank. Files hold ranges of documents in ascending id
order (nulls first), and the manifest, a Parquet table, has their order.

Two passes over the texts: one counts ids (a table of the vocabulary's size per
task), one encodes in document order. Nothing but the counts, which the
vocabulary bounds, reaches the driver.

Edge cases: null text counts as empty and holds the end id alone; an empty
table gives no file and no row; repeated ids stay separate documents, next to
one another.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rmalytics.llm import _bpe, _files
from rmalytics.llm._text import pieces, sums_by_row
from rmalytics.session import scratch_path

MAGIC = b"FRVB"
FILE_BYTES = 64 << 20
_LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], dtype=np.int64)


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control and data bytes of uint32 ranks."""
    more = (ranks >= 1 << 8).astype(np.uint8)
    more += ranks >= 1 << 16
    more += ranks >= 1 << 24
    quads = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    quads[: len(ranks)] = more
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    size = more.astype(np.int64) + 1
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), dtype=np.uint8)
    data[at] = ranks & 255
    for k in range(1, 4):
        longer = np.flatnonzero(more >= k)
        if not len(longer):
            break
        data[at[longer] + k] = ranks[longer] >> 8 * k & 255
    return control, data


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ranks of control and data bytes."""
    size = _LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _rows_of_ids(bpe: _bpe.ByteBpe, buf: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, each with the end id after it, and the number for each row."""
    s, e, rows = bpe.parts(buf, off)
    ids, each = bpe.ids.gather(bpe.ids.codes(buf, s, e))
    n = sums_by_row(each, rows)
    return np.insert(ids, np.cumsum(n), np.uint32(end_id)), n + 1


def frequency_ranks(df: DataFrame, path: str, end_id: int, text: str = "text") -> np.ndarray:
    """Token ids by falling count over all rows (ties: smaller id first), unused ids after them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe.load(path)
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for a, b, buf, off in pieces(batch.column(0)):
                s, e, _ = bpe.parts(buf, off)
                codes = bpe.ids.codes(buf, s, e)
                code, times = np.unique(codes, return_counts=True)
                ids, each = bpe.ids.gather(code)
                c = np.bincount(ids, weights=np.repeat(times, each), minlength=end_id + 1).astype(np.int64)
                c[end_id] += b - a
                if len(c) > len(total):
                    c[: len(total)] += total
                    total = c
                else:
                    total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "id long, n long")
    got = counts.groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    got = got.sort_values(["n", "id"], ascending=[False, True])
    ids = got["id"].to_numpy(dtype=np.int64)
    top = max([end_id, *ids.tolist(), _bpe.load(path).lib.get_vocab_size() - 1])
    rest = np.setdiff1d(np.arange(top + 1), ids)
    return np.concatenate([ids, rest]).astype(np.uint32)


def write_token_files(spark: SparkSession, df: DataFrame, path: str, folder: str, id_col: str = "doc_id", text: str = "text", end_id: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files of all rows to ``folder``; returns the manifest (file, part, block, n_docs, n_ids)."""
    _files.make_folder(folder)
    ranks = frequency_ranks(df, path, end_id, text)
    system, where = _files.open_fs(folder)
    with system.open_output_stream(f"{where}/ranks.npy", compression=None) as out:
        np.save(buffer := io.BytesIO(), ranks)
        out.write(buffer.getvalue())
    rank_of = np.zeros(len(ranks), dtype=np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)
    table = spark.sparkContext.broadcast(rank_of)  # as many entries as the vocabulary

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, to_rank = _bpe.load(path), table.value
        part, block, done = TaskContext.get().partitionId(), 0, []
        system, where = _files.open_fs(folder)
        out = name = None
        docs = ids_out = size = 0

        def close() -> None:
            nonlocal out, block, docs, ids_out, size
            if out is not None:
                out.close()
                done.append((name, part, block, docs, ids_out))
                out, block, docs, ids_out, size = None, block + 1, 0, 0, 0

        for batch in batches:
            keys = batch.column(0)
            for a, b, buf, off in pieces(batch.column(1)):
                ids, n = _rows_of_ids(bpe, buf, off, end_id)
                control, data = encode_ranks(to_rank[ids])
                if out is None:
                    name = _files.new_name(f"part-{part:06d}-{block:04d}", ".frvb")
                    out = system.open_output_stream(f"{where}/{name}", compression=None)
                    out.write(MAGIC)
                own = keys.slice(a, b - a)
                for x in (
                    np.array([b - a, len(ids), len(control), len(data), 0], dtype="<i8"),
                    own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"),
                    own.is_null().to_numpy(zero_copy_only=False).astype(np.uint8),
                    n.astype("<i8"),
                    control,
                    data,
                ):
                    out.write(x.tobytes())
                docs, ids_out, size = docs + b - a, ids_out + len(ids), size + len(data) + len(control)
                if size >= file_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["file", "part", "block", "n_docs", "n_ids"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest = rows.mapInArrow(write, "file string, part long, block long, n_docs long, n_ids long")
    manifest.write.parquet(f"{folder}/manifest.parquet")
    return spark.read.parquet(f"{folder}/manifest.parquet")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (uint32, little-endian) of every document in the files."""
    manifest = spark.read.parquet(f"{folder}/manifest.parquet")
    # one row for each file of tens of MB
    before = F.sum("n_ids").over(W.orderBy("part", "block").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.select("file", F.coalesce(before, F.lit(0)).alias("start"))
    files = files.repartition(max(1, spark.sparkContext.defaultParallelism * 2))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = _files.open_fs(folder)
        with system.open_input_stream(f"{where}/ranks.npy", compression=None) as f:
            ranks = np.load(io.BytesIO(f.read()))
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_stream(f"{where}/{name}", compression=None) as f:
                    if f.read(4) != MAGIC:
                        raise ValueError(f"{name} is not a token file")
                    while len(head := f.read(40)) == 40:
                        docs, n_ids, n_control, n_data, _ = np.frombuffer(head, dtype="<i8").tolist()
                        keys = np.frombuffer(f.read(8 * docs), dtype="<i8")
                        null = np.frombuffer(f.read(docs), dtype=np.uint8).astype(bool)
                        n = np.frombuffer(f.read(8 * docs), dtype="<i8")
                        control = np.frombuffer(f.read(n_control), dtype=np.uint8)
                        data = np.frombuffer(f.read(n_data), dtype=np.uint8)
                        raw = ranks[decode_ranks(control, data, n_ids)].astype("<u4").tobytes()
                        ends = np.cumsum(n)
                        bounds = pa.py_buffer((4 * np.concatenate([[0], ends])).astype(np.int32).tobytes())
                        blobs = pa.Array.from_buffers(pa.binary(), docs, [None, bounds, pa.py_buffer(raw)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys, mask=null), pa.array(start + ends - n), pa.array(n), blobs], ["doc_id", "start", "n_tokens", "ids"]
                        )
                        start += n_ids

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_binary(spark: SparkSession, df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Writes the token files of all rows and reads them back (doc_id, start, n_tokens, ids)."""
    folder = scratch_path(spark, "tokens")
    write_token_files(spark, df, path, folder, id_col, text, end_id)
    return read_token_files(spark, folder)


def ids_crc32(df: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids' bytes."""
    return df.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
