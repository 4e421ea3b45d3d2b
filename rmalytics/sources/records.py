"""Report files: their header records, and the records of large files by many tasks.

A quoted field may hold newlines, so where a byte range of a file is cut says
nothing about where a record starts. Ranges are those of Spark's text scan,
which hands out whole lines. A line either leaves the state "inside a quoted
field" as it was or sets it: without a quote it changes nothing, otherwise two
patterns tell the state behind the line for either state before it. The lines
of a range, put together, do the same to the state at its start, so one slim
scan and a running fold over the ranges give each range's true start state.
The second scan joins the lines of each record within its range; only records
that reach into the next range, of which a range has one at most, meet by a
shuffle. The result is that of a scan of the whole file, but for a file whose
last field is never closed: there the file's final newline isn't kept in it.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ENCODING = "ISO-8859-1"
#: a header record that isn't closed by then is the first line alone
HEADER_BYTES = 1 << 20
READ_BYTES = 1 << 16
_HUGE = str(1 << 50)
#: of these Spark reads the whole file as one stream
_PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".lzo", ".snappy", ".zst", ".zstd", ".xz")
_ARROW_CODEC = {".gz": "gzip", ".bz2": "bz2"}

# What a line does to the state "inside a quoted field".
KEEP, LEAVE, ENTER, SWAP = 0, 1, 2, 3

_QUOTED = r'(?:[^"]++|"")*+'            # the inside of a quoted field
_FIELD = rf'(?:"{_QUOTED}"[^\t]*+|[^"\t][^\t]*+)?+'
#: a record's line that ends inside a quoted field
OPENED = rf'^(?:{_FIELD}\t)*+"{_QUOTED}$'
#: a line that starts inside a quoted field and ends inside one: the same, or another after it
STILL_OPEN = rf'^{_QUOTED}(?:$|"[^\t]*+\t(?:{_FIELD}\t)*+"{_QUOTED}$)'


@dataclass(frozen=True)
class ReportFile:
    """A report file, with its column names (none where it is empty)."""

    path: str
    uri: str  # as Spark lists it
    size: int
    names: tuple[str, ...]
    header_bytes: int
    line_end: str  # the first one of the file, which counts for all of it

    @property
    def crlf(self) -> int:
        return int(self.line_end == "\r\n")

    @property
    def packed(self) -> bool:
        return self.path.lower().endswith(_PACKED)

    def splits(self, split_bytes: int) -> bool:
        """Whether it is read by many tasks."""
        return self.line_end != "\r" and not self.packed and self.size > split_bytes > self.header_bytes


def _header(lines: Iterator[bytes]) -> tuple[bytes, int, str]:
    """The first record that isn't blank, the bytes up to its end, and the file's first line end."""
    held, first, passed, end = b"", None, 0, None
    for line in lines:
        passed += len(line) + 1
        if end is None:
            end = "\r" if b"\r" in line[:-1] else "\r\n" if line.endswith(b"\r") else "\n"
        if first is None:
            if not line.strip(b"\r"):
                continue
            first = line
        held = held + b"\n" + line if held else line
        if held.count(b'"') % 2 == 0:
            return held, passed, end
        if len(held) > HEADER_BYTES:
            break
    return first or b"", passed, end or "\n"


_HEADER_ROW = "uri string, size long, header binary, passed long, line_end string"


def _header_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["uri", "size", "header", "passed", "line_end"])


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(uri.removeprefix("file:")).lstrip("/")
    return fs.FileSystem.from_uri(quote(uri, safe="/:%@?=&+,;~"))


def _first_lines(stream: pa.NativeFile) -> Iterator[bytes]:
    """The stream's lines, read as far as they are asked for."""
    held = b""
    while chunk := stream.read(READ_BYTES):
        *lines, held = (held + chunk).split(b"\n")
        yield from lines
    if held:
        yield held


def _headers_by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers of files that Arrow's file systems open; null for others."""
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            row = (uri, None, None, None, None)
            ending = "." + uri.lower().rsplit(".", 1)[-1]
            if ending not in _PACKED or ending in _ARROW_CODEC:
                try:
                    system, path = _opened(uri)
                    size = system.get_file_info(path).size
                    with system.open_input_stream(path, compression=_ARROW_CODEC.get(ending)) as f:
                        row = (uri, size, *_header(_first_lines(f)))
                except (pa.ArrowException, OSError):
                    pass  # left to Spark's own reader
            yield _header_rows([row])


def _headers_by_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the one file of the task."""
    uri, size = None, 0

    def lines() -> Iterator[bytes]:
        nonlocal uri, size
        for batch in batches:
            for line in batch.column(0):
                if uri is None:
                    uri, size = batch.column(1)[0].as_py(), batch.column(2)[0].as_py()
                yield line.as_py()

    found = _header(lines())
    yield _header_rows([(uri, size, *found)] if uri is not None else [])


def report_files(spark: SparkSession, paths: str | list[str]) -> list[ReportFile]:
    """The files under ``paths``, empty ones included, each with its header.

    Executors open each file and stop behind its header record, so what is read
    doesn't grow with the files; the driver gets the header records. Files in a
    store, or packed in a way, that only Spark's readers know are scanned.
    """
    every = sorted(set(spark.read.text(paths).inputFiles()))
    if not every:
        return []
    rows = spark.createDataFrame([(f,) for f in every], "uri string").mapInArrow(_headers_by_range, _HEADER_ROW).collect()
    found = {r.uri: r for r in rows if r.header is not None}
    left = [r.uri for r in rows if r.header is None]
    if left:
        own = spark.newSession()  # its settings give each task one file from its start
        own.conf.set("spark.sql.files.maxPartitionBytes", _HUGE)
        own.conf.set("spark.sql.files.openCostInBytes", _HUGE)
        lines = own.read.option("lineSep", "\n").text([unquote(f) for f in left])
        lines = lines.select(F.col("value").cast("binary"), F.input_file_name().alias("uri"), F.col("_metadata.file_size").alias("size"))
        found |= {r.uri: r for r in lines.mapInArrow(_headers_by_scan, _HEADER_ROW).collect()}
    out = []
    for uri in every:
        path, r = _plain(uri), found.get(uri)
        if r is None or not r.size:
            out.append(ReportFile(path, uri, 0, (), 0, "\n"))
            continue
        record = bytes(r.header).decode(ENCODING)
        if r.line_end == "\r":  # old line ends: the record is all that stands before the first
            record = record.split("\r")[0]
        record = record.removesuffix("\r").replace("\r\n", "\n")
        names = next(csv.reader(io.StringIO(record, newline=""), delimiter="\t"), [])
        out.append(ReportFile(path, uri, r.size, _unique(names), r.passed, r.line_end))
    return out


def _plain(uri: str) -> str:
    """A file's path as readers take it."""
    path = unquote(uri)
    return "file:/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _unique(names: list[str]) -> tuple[str, ...]:
    """Of columns with one name the last keeps it, as in a mapping by name."""
    return tuple(n if n not in names[k + 1:] else f"{n} (column {k + 1})" for k, n in enumerate(names))


# --- records of large files -------------------------------------------------------


def line_turn(line: Column) -> Column:
    """What a line does to the state (KEEP, LEAVE, ENTER or SWAP)."""
    opened, still = line.rlike(OPENED), line.rlike(STILL_OPEN)
    turn = F.when(opened & still, ENTER).when(opened, SWAP).when(still, KEEP).otherwise(LEAVE)
    return F.when(F.instr(line, '"') == 0, KEEP).otherwise(turn).cast("int")


def states(turns: np.ndarray, before: int) -> np.ndarray:
    """The state (0 or 1) behind each line."""
    at = np.arange(len(turns))
    fixed = (turns == LEAVE) | (turns == ENTER)
    last = np.maximum.accumulate(np.where(fixed, at, -1))
    swaps = np.cumsum(turns == SWAP)
    base = np.where(last >= 0, turns[last] == ENTER, before == 1)
    return (base ^ ((swaps - np.where(last >= 0, swaps[last], 0)) % 2 == 1)).astype(np.int64)


def _joined_turn(behind_outside: int, behind_inside: int) -> int:
    return {(0, 1): KEEP, (0, 0): LEAVE, (1, 1): ENTER, (1, 0): SWAP}[behind_outside, behind_inside]


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows with equal values."""
    n = len(columns[0])
    differ = np.zeros(max(n - 1, 0), dtype=bool)
    for c in columns:
        differ |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(differ) + 1).tolist(), n]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, at, turn: what the lines of a range, in order, do to the state together."""
    now, ends = None, [0, 1]

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*now, _joined_turn(*ends))], ["file", "at", "turn"])

    for batch in batches:
        file, at, turn = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        for a, b in _runs(file, at):
            if (int(file[a]), int(at[a])) != now:
                if now is not None:
                    yield given()
                now, ends = (int(file[a]), int(at[a])), [0, 1]
            ends = [int(states(turn[a:b], s)[-1]) for s in ends]
    if now is not None:
        yield given()


# What a part of a record is.
WHOLE, GOES_ON, CARRIED = 0, 1, 2


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, at, part, record of lines (line, file, at, turn, inside, last, crlf) in file order.

    Each line comes with a newline before it, so that the lines of a record lie
    side by side in the batch's buffer: a record is a longer slice of it. The
    header (the first record that isn't blank) and blank lines are left out.
    """
    now, state, held, own, header = None, 0, b"", True, False

    def rows(part: int, records: pa.Array) -> pa.RecordBatch:
        n = len(records)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, now[0])), pa.array(np.full(n, now[1])), pa.array(np.full(n, part)), records], ["file", "at", "part", "record"])

    def ended(last: bool) -> Iterator[pa.RecordBatch]:
        """What the range leaves open; in the file's last range it is a whole record."""
        if held:
            yield rows(WHOLE if last and own else GOES_ON if own else CARRIED, pa.array([held], pa.binary()))

    was_last = False
    for batch in batches:
        file, at, turn, inside, last, crlf = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(1, 7))
        for a, b in _runs(file, at):
            if (int(file[a]), int(at[a])) != now:
                yield from ended(was_last)
                now, held = (int(file[a]), int(at[a])), b""
                state, header = int(inside[a]), int(at[a]) == 0
                own, was_last = state == 0, bool(last[a])
            behind = states(turn[a:b], state)
            before = np.concatenate([[state], behind[:-1]])
            lines = batch.column(0).slice(a, b - a)
            off = np.frombuffer(lines.buffers()[1], dtype=np.int32)[lines.offset : lines.offset + b - a + 1]
            data = lines.buffers()[2]
            starts = np.flatnonzero(before == 0)
            first = int(off[starts[0]]) if len(starts) else int(off[-1])
            held += data[int(off[0]) : first].to_pybytes() if data is not None and first > off[0] else b""
            if len(starts):
                if held:  # closed by the lines before the first start
                    yield rows(WHOLE if own else CARRIED, pa.array([held], pa.binary()))
                    held, own = b"", True
                bounds = np.append(off[starts], off[-1]).astype(np.int32)
                if behind[-1]:  # the last record goes on
                    held = data[int(bounds[-2]) : int(bounds[-1])].to_pybytes()
                    bounds = bounds[:-1]
                n = len(bounds) - 1
                if n:
                    records = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.tobytes()), data])
                    size = np.diff(bounds)
                    full = size > 1
                    if crlf[a]:
                        for k in np.flatnonzero(size == 2):
                            full[k] = records[int(k)].as_py() != b"\n\r"
                    if header and full.any():
                        full[int(np.argmax(full))], header = False, False
                    yield rows(WHOLE, records.filter(pa.array(full)))
            state = int(behind[-1])
    yield from ended(was_last)


def split_records(spark: SparkSession, files: list[ReportFile], split_bytes: int) -> DataFrame:
    """record (text), _file: the records of ``files``, one task for each ``split_bytes``.

    Runs the first scan. The driver gets one small row for each range that
    holds a quote (at most one for ``split_bytes`` of input).
    """
    own = spark.newSession()
    # ranges are exactly of this size, whatever runs on the cluster at the time of each scan
    own.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", str(split_bytes))
    lines = own.read.option("lineSep", "\n").text([f.path for f in files])
    meta = F.col("_metadata")
    lines = lines.select(F.decode(F.col("value").cast("binary"), ENCODING).alias("line"), F.input_file_name().alias("uri"),
                         meta["file_block_start"].alias("at"), meta["file_size"].alias("size"))
    # one row for each large file, and below one for each range at most: their size is bounded by the listing
    numbers = own.createDataFrame([(f.uri, k, f.crlf, f.uri.replace("file:///", "file:/", 1)) for k, f in enumerate(files)], "uri string, file long, crlf int, _file string")
    lines = lines.join(F.broadcast(numbers.drop("_file")), "uri").withColumn("turn", line_turn(F.col("line")))
    turns = lines.where(F.col("turn") != KEEP).select("file", "at", "turn").mapInArrow(_folded, "file long, at long, turn long")
    turn_of = {(r.file, r.at): r.turn for r in turns.collect()}
    inside, straddled = [], set()
    for k, f in enumerate(files):
        state = 0
        for at in range(0, f.size, split_bytes):
            if state:
                inside.append((k, at, 1))
                straddled |= {(k, at - split_bytes), (k, at)}
            turn = turn_of.get((k, at), KEEP)
            state = {KEEP: state, LEAVE: 0, ENTER: 1, SWAP: 1 - state}[turn]
    starts = own.createDataFrame(inside, "file long, at long, inside long")
    lines = lines.join(F.broadcast(starts), ["file", "at"], "left")
    slim = lines.select(F.concat(F.lit("\n"), "line").alias("line"), "file", "at", "turn", F.coalesce("inside", F.lit(0).cast("long")).alias("inside"),
                        (F.col("at") + split_bytes >= F.col("size")).alias("last"), "crlf")
    kind = "file long, at long, part long, record binary"
    records = slim.mapInArrow(_assembled, kind).where(F.col("part") == WHOLE).select("file", "record")
    if straddled:
        across = own.createDataFrame(sorted(straddled), "file long, at long")
        parts = slim.join(F.broadcast(across), ["file", "at"]).select("line", "file", "at", "turn", "inside", "last", "crlf").mapInArrow(_assembled, kind)
        parts = parts.where(F.col("part") != WHOLE)
        # a record's first part, then what following ranges carried on
        order = W.partitionBy("file").orderBy("at", F.desc("part"))
        parts = parts.withColumn("number", F.sum(F.when(F.col("part") == GOES_ON, 1).otherwise(0)).over(order))
        whole = parts.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("at", F.decode("record", "UTF-8").alias("text")))).alias("parts"))
        whole = whole.select("file", F.encode(F.array_join(F.col("parts.text"), ""), "UTF-8").alias("record"))
        records = records.unionByName(whole)
    # without the newline before it; in files with \r\n that is a newline, as in a scan of the whole file
    records = records.join(F.broadcast(numbers), "file").withColumn("t", F.expr("substring(decode(record, 'UTF-8'), 2)"))
    bare = F.replace(F.when(F.col("t").endswith("\r"), F.expr("left(t, length(t) - 1)")).otherwise(F.col("t")), F.lit("\r\n"), F.lit("\n"))
    records = records.select(F.when(F.col("crlf") == 1, bare).otherwise(F.col("t")).alias("record"), "_file")
    # bound to the caller's session, whose settings hold for what is built on it
    return spark.createDataFrame([], records.schema).unionByName(records)


def parsed_records(records: DataFrame, names: tuple[str, ...], options: dict[str, str]) -> DataFrame:
    """The records' fields as string columns by name, and ``_file``."""
    keep = {k: v for k, v in options.items() if k not in ("header", "inferSchema", "encoding")}
    keep["lineSep"] = "\n"
    kind = ", ".join(f"c{k} string" for k in range(len(names)))
    # inline, not field access: a record is parsed once for all its columns
    fields = records.select(F.inline(F.array(F.from_csv("record", kind, keep))), "_file")
    return fields.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)], "_file")
