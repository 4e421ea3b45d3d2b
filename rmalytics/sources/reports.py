"""Report-file scans (tab separated, header row, ISO-8859-1) and header checks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rmalytics.schemas import RETURNS_HEADERS, SALES_RENAME
from rmalytics.sources.records import ReportFile, parsed_records, report_files, split_records

# Dialect of the marketplace's flat-file reports.
REPORT_OPTIONS = {
    "sep": "\t",
    "header": "true",
    "inferSchema": "false",
    "encoding": "ISO-8859-1",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",  # quoted fields may hold newlines
    "mode": "PERMISSIVE",
}


class ReportHeaderError(ValueError):
    """The file lacks required columns; nothing was loaded."""

    def __init__(self, kind: str, missing: Iterable[str]):
        self.missing = sorted(missing)
        super().__init__(f"{kind} report is missing columns: {', '.join(self.missing)}")


def report_layouts(spark: SparkSession, paths: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each header record: {column names: files}; empty files have no names."""
    return {names: [f.path for f in files] for names, files in _layouts(report_files(spark, paths)).items()}


def _layouts(files: list[ReportFile]) -> dict[tuple[str, ...], list[ReportFile]]:
    layouts: dict[tuple[str, ...], list[ReportFile]] = {}
    for f in files:
        layouts.setdefault(f.names, []).append(f)
    return layouts


def read_report(spark: SparkSession, paths: str | list[str], multiline: bool = True) -> DataFrame:
    """All columns as strings, each file's located by its own header (order
    free, extras kept, NULL in files without them), and the file as ``_file``.

    Quoted fields may span lines. Files up to ``spark.sql.files.maxPartitionBytes``
    are parsed by one task each, larger ones by a task for each such range
    (``sources/records.py``). ``multiline=False`` promises that no field holds
    a newline, which saves the latter a scan.
    """
    return _read_layouts(spark, _layouts(report_files(spark, paths)), multiline)


def _read_layouts(spark: SparkSession, layouts: dict[tuple[str, ...], list[ReportFile]], multiline: bool,
                  trim_names: bool = False) -> DataFrame:
    opts = {**REPORT_OPTIONS, "multiLine": str(multiline).lower()}
    split_bytes = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    out = None
    for names, files in layouts.items():
        if not names:
            continue
        large = [f for f in files if multiline and f.splits(split_bytes)]
        packed = [f.path for f in files if f.packed]
        small = [f.path for f in files if f not in large and not f.packed]
        parts = []
        # the files' own header row is skipped, the names are those read from it
        schema = StructType([StructField(c, StringType()) for c in names])
        for some in (small, packed):
            if some:
                by = spark if some is small else _packed_session(spark, split_bytes)
                one = by.read.options(**opts).schema(schema).csv(some).select("*", F.col("_metadata.file_path").alias("_file"))
                # bound to the caller's session, whose settings hold for what is built on it
                parts.append(one if by is spark else spark.createDataFrame([], one.schema).limit(0).unionByName(one))
        if large:
            parts.append(parsed_records(split_records(spark, large, split_bytes), names, opts))
        for one in parts:
            if trim_names:
                one = one.toDF(*[c.strip() for c in one.columns])
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return spark.createDataFrame([], "_file string") if out is None else out


#: how many times its size a packed report holds, roughly
PACKED_GAIN = 8


def _packed_session(spark: SparkSession, split_bytes: int) -> SparkSession:
    """Its scans put no more packed files into a task than hold about ``split_bytes``
    (or one file), so that the rows a task sorts fit its memory."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(max(split_bytes // PACKED_GAIN, 1)))
    return own


def _bytes(setting: str) -> int:
    """A size setting such as ``134217728b`` or ``128m``."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([bkmgt]?)b?\s*", setting.lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def check_returns_header(df: DataFrame) -> DataFrame:
    """The 32 returns columns must all be present (names exact)."""
    missing = set(RETURNS_HEADERS) - set(df.columns)
    if missing:
        raise ReportHeaderError("returns", missing)
    return df


def check_sales_header(df: DataFrame) -> DataFrame:
    """Trim header names, then require the 39 sales columns.

    A column may be named in the report's kebab case or already in the
    table's snake case; both are renamed to snake case. Extras are kept
    here and dropped by the projection.
    """
    trimmed = df.toDF(*[c.strip() for c in df.columns])
    to_table = {c: SALES_RENAME.get(c, c) for c in trimmed.columns}
    missing = set(SALES_RENAME.values()) - set(to_table.values())
    if missing:
        inverse = {v: k for k, v in SALES_RENAME.items()}
        raise ReportHeaderError("sales", {inverse[m] for m in missing})
    renamed = trimmed.withColumnsRenamed({k: v for k, v in to_table.items() if k != v})
    return renamed


def prepared_report(spark: SparkSession, kind: str, paths, on_error: str, multiline: bool) -> DataFrame:
    """Scan, header check and typed projection, with ``_errors`` and ``_file``.

    A file without the required columns, such as an empty one, raises
    ReportHeaderError (``fail``), or is one rejected row that names the file
    (``quarantine``): the other files are loaded.
    """
    from rmalytics.operators.ingest import prepare_returns, prepare_sales

    required = RETURNS_HEADERS if kind == "returns" else tuple(SALES_RENAME)
    check = check_returns_header if kind == "returns" else check_sales_header
    prepare = prepare_returns if kind == "returns" else prepare_sales
    good, rejected = {}, []
    for names, files in _layouts(report_files(spark, paths)).items():
        try:
            check(spark.createDataFrame([], StructType([StructField(c, StringType()) for c in names])))
            good[names] = files
        except ReportHeaderError as e:
            if on_error == "fail":
                raise
            rejected += [(f.path, [str(e) if f.size else f"{e} (the file is empty)"]) for f in files]
    raw = _read_layouts(spark, good, multiline, trim_names=kind == "sales") if good else \
        spark.createDataFrame([], StructType([StructField(c, StringType()) for c in (*required, "_file")]))
    out = prepare(check(raw))
    if rejected:  # one row for each file
        out = out.unionByName(spark.createDataFrame(rejected, "_file string, _errors array<string>"),
                              allowMissingColumns=True)
    return out


def load_returns_report(spark: SparkSession, paths, on_error: str = "fail", multiline: bool = True):
    """Scan + header check (eager, raises ReportHeaderError) + typed projection.

    Returns the table-shaped DataFrame (``on_error='fail'``: an action on it
    fails at the first bad row) or ``(good, bad)`` with ``'quarantine'``.
    """
    from rmalytics.operators.ingest import enforce

    return enforce(prepared_report(spark, "returns", paths, on_error, multiline), on_error)


def load_sales_report(spark: SparkSession, paths, on_error: str = "fail", multiline: bool = True):
    """Scan + header check + typed projection of all-orders (sales) reports."""
    from rmalytics.operators.ingest import enforce

    return enforce(prepared_report(spark, "sales", paths, on_error, multiline), on_error)


def _ingest(kind, spark, paths, table_path, on_error, multiline, rejected_path):
    from rmalytics.operators.ingest import enforce, raise_row_error
    from rmalytics.sources.tables import append_table

    prepared = prepared_report(spark, kind, paths, on_error, multiline)
    if on_error != "quarantine":
        try:
            append_table(enforce(prepared, on_error), table_path)
        except Exception as exc:  # noqa: BLE001 - translated below
            raise_row_error(exc)
        return None
    # files are parsed for each output: keeping all rows for both takes memory or disk of the load's
    # size; rejected rows are safe before good ones count
    good, bad = enforce(prepared, on_error)
    where = f"{(rejected_path or table_path.rstrip('/') + '_rejected').rstrip('/')}/load={uuid.uuid4().hex[:12]}"
    bad.write.parquet(where)
    append_table(good, table_path)
    return spark.read.parquet(where)


def ingest_returns(spark: SparkSession, paths, table_path: str, on_error: str = "fail",
                   multiline: bool = True, rejected_path: str | None = None):
    """Load returns reports and append them to the table at ``table_path``.

    ``fail``: one bad row fails the load and nothing is written
    (ReportRowError). ``quarantine``: the bad rows, with ``_errors`` and
    ``_file``, are written to a folder of this load under ``rejected_path``
    (default ``<table_path>_rejected``), then the good ones are appended;
    returns this load's rejected rows, read from there.
    """
    return _ingest("returns", spark, paths, table_path, on_error, multiline, rejected_path)


def ingest_sales(spark: SparkSession, paths, table_path: str, on_error: str = "fail",
                 multiline: bool = True, rejected_path: str | None = None):
    """Load all-orders reports and append them to the table at ``table_path``
    (policies as for returns)."""
    return _ingest("sales", spark, paths, table_path, on_error, multiline, rejected_path)


__all__ = ["REPORT_OPTIONS", "ReportHeaderError", "check_returns_header",
           "check_sales_header", "ingest_returns", "ingest_sales", "load_returns_report",
           "load_sales_report", "read_report", "report_layouts"]
