"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC/1.1
records of about ``frame_bytes``, and at its end a seek table in a skippable
frame (the public seekable format: magic 0x184D2A5E, compressed and plain size
of each frame, number of frames, a descriptor byte, magic 0x8F92EAB1). The
manifest maps each record's identifier to its bundle, frame and offset inside
the plain frame, so that one record is read by inflating one frame.

Records whose payload equals that of a record with a smaller page id are
``revisit`` records: they carry the digest and the identifier they refer to,
no payload. Pages are matched by SHA-256 and length of the payload; the group
of a common payload is reduced to its smallest id before any row meets another.

Edge cases: a null html is an empty payload; null page ids come after all
others, and where a payload has no other id all its records are responses; rows
with the same (smallest) id and payload are all responses; null urls give no
target header; other columns are left out. An empty table writes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rmalytics.llm import _files
from rmalytics.session import scratch_path

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20
DATE = "2020-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def with_records(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, payload (binary) and refers_to (null for a response)."""
    rows = df.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(html).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("_key", F.when(F.octet_length("payload") >= least, F.concat_ws(":", F.sha2("payload", 256), F.octet_length("payload"))))
    first = rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("page_id").alias("_first"))
    # null keys (payloads under ``least``) match nothing; a common key's rows are split by the skew-join rule
    out = rows.join(first, "_key", "left")
    later = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.select("page_id", "url", "payload", F.when(later, F.col("_first")).alias("refers_to"))


def record_id(page_id: int | None, place: str) -> str:
    """A stable URN; rows without an id are named by their place."""
    h = hashlib.sha1(f"page {page_id}".encode() if page_id is not None else f"row {place}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, place: str) -> bytes:
    """One WARC record; the page ids are in headers of their own."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = payload if refers_to is None else b""
    kind = "response" if refers_to is None else "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, place)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, '')}", f"X-Refers-To-Page-ID: {refers_to}"]
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at ``at``."""
    head_end = data.index(_END, at)
    first, *lines = data[at:head_end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines)
    a = head_end + len(_END)
    b = a + int(head["Content-Length"])
    return head, data[a:b], b + len(_END)


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame of an open file."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((at, c, d))
        at += c
    return out


def write_bundles(spark: SparkSession, records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes ``with_records`` rows to bundles in ``folder``; returns the manifest
    (record_id, page_id, bundle, frame, at, size), one row for each record."""
    _files.make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = _files.open_fs(folder)
        squeeze = zstandard.ZstdCompressor(level=3)
        part, out, name, bundles = TaskContext.get().partitionId(), None, "", 0
        frames: list[tuple[int, int]] = []
        held: list[bytes] = []
        size = written = 0
        rows: list[tuple] = []

        def frame() -> None:
            nonlocal held, size, written
            if held:
                done = squeeze.compress(b"".join(held))
                out.write(done)
                frames.append((len(done), size))
                held, size, written = [], 0, written + len(done)

        def close() -> None:
            nonlocal out, frames, written
            if out is not None:
                frame()
                out.write(seek_table(frames))
                out.close()
                out, frames, written = None, [], 0

        names = ["record_id", "page_id", "bundle", "frame", "at", "size"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for n_batch, batch in enumerate(batches):
            for k in range(batch.num_rows):
                page, url, payload, to = (c[k].as_py() for c in batch.columns)
                if out is None:
                    name = _files.new_name(f"part-{part:06d}-{bundles:04d}", ".warc.zst")
                    out, bundles = system.open_output_stream(f"{where}/{name}", compression=None), bundles + 1
                place = f"{part} {n_batch} {k}"
                one = record(page, url, payload, to, place)
                rows.append((record_id(page, place), page, name, len(frames), size, len(one)))
                held.append(one)
                size += len(one)
                if size >= frame_bytes:
                    frame()
                    if written >= bundle_bytes:
                        close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)
            rows = []
        close()

    manifest = records.mapInArrow(write, "record_id string, page_id long, bundle string, frame long, at long, size long")
    manifest.write.parquet(f"{folder}/manifest.parquet")
    return spark.read.parquet(f"{folder}/manifest.parquet")


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload
    (null for a revisit) of every record, frame by frame through the seek tables."""
    frames = spark.read.parquet(f"{folder}/manifest.parquet").select("bundle", "frame").distinct()
    # frames of a bundle are dealt round to the tasks: each opens by its own offset
    frames = frames.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "bundle", "frame")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = _files.open_fs(folder)
        inflate = zstandard.ZstdDecompressor()
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        tables: dict[str, list] = {}
        for batch in batches:
            for bundle, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{where}/{bundle}") as f:
                    if bundle not in tables:
                        tables = {bundle: read_seek_table(f, f.size())} if len(tables) > 64 else tables | {bundle: read_seek_table(f, f.size())}
                    at, c, d = tables[bundle][k]
                    f.seek(at)
                    data = inflate.decompress(f.read(c), max_output_size=d)
                rows, at = [], 0
                while at < len(data):
                    head, block, at = parse_record(data, at)
                    page, to = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    answer = head["WARC-Type"] == "response"
                    if answer and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                        raise ValueError(f"{bundle}, frame {k}: a payload differs from its digest")
                    rows.append(
                        (int(page) if page else None, head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), digest, head["WARC-Type"], int(to) if to else None, block if answer else None)
                    )
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return frames.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def read_record(folder: str, bundle: str, frame: int, at: int, size: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the manifest: reads the seek table and one frame."""
    system, where = _files.open_fs(folder)
    with system.open_input_file(f"{where}/{bundle}") as f:
        start, c, d = read_seek_table(f, f.size())[frame]
        f.seek(start)
        data = zstandard.ZstdDecompressor().decompress(f.read(c), max_output_size=d)
    head, block, end = parse_record(data, at)
    if end - at != size:
        raise ValueError("the manifest doesn't fit the bundle")
    return head, block


def warc_bundles(spark: SparkSession, df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes the bundles of all rows and reads them back (see ``read_bundles``)."""
    folder = scratch_path(spark, "warc")
    write_bundles(spark, with_records(df, id_col, url, html, least), folder)
    return read_bundles(spark, folder)
