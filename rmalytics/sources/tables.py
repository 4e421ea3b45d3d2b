"""The two stored tables: Parquet, partitioned by year and load, append only.

Every load has folders of its own, ``year=<y>/load_id=<id>``: a batch load an
id ``l...`` that no other has, a stream's micro-batch ``b<batch number>``, so
that a replayed micro-batch replaces what it wrote. ``compact`` folds the loads
of both kinds into one, ``c...``. Which folders count is in the newest file of
``_loads/``: the compacted loads, the last micro-batch folded into them, and
batch loads they replace. A folder is seen once that file names it, or from the
start for loads that aren't folded, so readers see every row once while a
compaction runs, after it, and after one that failed; a micro-batch replayed
once it is folded writes a folder that doesn't count.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rmalytics.functions.keys import with_stored_keys
from rmalytics.schemas import RETURNS_SCHEMA, SALES_SCHEMA
from rmalytics.sources import paths

LOADS = "_loads"
#: Columns of ids and texts that hardly repeat give up their dictionary early:
#: building one took a third of a load's writing. Few repeated values fit in.
WRITE_OPTIONS = {"compression": "zstd", "parquet.dictionary.page.size": str(64 << 10)}


@dataclass(frozen=True)
class Loads:
    """Which of a table's loads count."""

    version: int = 0
    compacted: tuple[str, ...] = ()
    folded_to: int = -1  # the last micro-batch that a compacted load holds
    replaced: tuple[str, ...] = field(default=())  # batch and compacted loads that others hold

    def counts(self, load_id: str) -> bool:
        if load_id[:1] == "c":
            return load_id in self.compacted
        if load_id[:1] == "b":
            return int(load_id[1:]) > self.folded_to
        return load_id not in self.replaced

    def condition(self) -> Column:
        """The same on the partition column, so that other folders aren't read."""
        load, kind = F.col("load_id"), F.substring("load_id", 1, 1)
        out = load.isin(list(self.compacted)) | (kind != "c") if self.compacted else kind != "c"
        if self.folded_to >= 0:
            out &= (kind != "b") | (load > F.lit(batch_load(self.folded_to)))
        return out & ~load.isin(list(self.replaced)) if self.replaced else out


def batch_load(batch_id: int) -> str:
    return f"b{batch_id:09d}"


def loads(spark: SparkSession, path: str) -> Loads:
    """The newest list of loads."""
    folder = f"{path.rstrip('/')}/{LOADS}"
    versions = [n for n in paths.names(spark, folder) if n.startswith("v")]
    if not versions:
        return Loads()
    d = json.loads(paths.read_text(spark, f"{folder}/{versions[-1]}"))
    return Loads(int(versions[-1][1:]), tuple(d["compacted"]), d["folded_to"], tuple(d["replaced"]))


def _listed(spark: SparkSession, path: str, now: Loads) -> bool:
    """Writes a list of loads, unless there is one of its version."""
    text = json.dumps({"compacted": now.compacted, "folded_to": now.folded_to, "replaced": now.replaced})
    return paths.write_text(spark, f"{path}/{LOADS}/v{now.version:010d}", text)


def _close(spark: SparkSession, path: str, load_id: str) -> None:
    """Notes that a load is written: from now on it may be folded."""
    paths.write_text(spark, f"{path.rstrip('/')}/{LOADS}/closed-{load_id}", "")


def close_batch(spark: SparkSession, path: str, batch_id: int) -> None:
    """Notes that a micro-batch, and so all before it, is written."""
    _close(spark, path, batch_load(batch_id))


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table; one that has never been loaded is empty, with the declared columns."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], schema)
        raise
    if "load_id" in df.columns:
        now = loads(spark, path)
        if now.version:  # else nothing has been folded yet: every folder counts
            df = df.where(now.condition())
    # `year` is a directory name; keep it an int even where partition type
    # inference is off (the cast is a no-op otherwise and pruning still works).
    return df.withColumn("year", F.col("year").cast("int"))


def read_returns(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, RETURNS_SCHEMA)


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, SALES_SCHEMA)


def append_table(df: DataFrame, path: str, max_records_per_file: int = 5_000_000) -> None:
    """Append rows (no dedup, no upsert: a file loaded twice counts twice).

    One job through Spark's file commit protocol: a failed load leaves no
    visible files. Rows are clustered by month inside each year partition so
    row-group statistics on ``month_no`` skip data for month-range queries.
    The folded text keys that operators group and match on are stored too.
    """
    load_id = f"l{uuid.uuid4().hex[:12]}"
    _write(with_stored_keys(df), path, load_id, max_records_per_file)
    _close(df.sparkSession, path, load_id)


def _write(df: DataFrame, path: str, load_id: str, max_records_per_file: int, mode: str = "append") -> None:
    (df.withColumn("load_id", F.lit(load_id)).sortWithinPartitions("year", "month_no")
       .write.mode(mode)
       .option("partitionOverwriteMode", "dynamic")
       .option("maxRecordsPerFile", max_records_per_file)
       .options(**WRITE_OPTIONS)
       .partitionBy("year", "load_id")
       .parquet(path))


def write_batch(df: DataFrame, path: str, batch_id: int, max_records_per_file: int = 5_000_000) -> None:
    """A micro-batch's rows, instead of those that an earlier attempt wrote."""
    _write(with_stored_keys(df), path, batch_load(batch_id), max_records_per_file, "overwrite")


def compact(spark: SparkSession, path: str, max_records_per_file: int = 5_000_000) -> Loads:
    """Folds all closed loads into one folder for each year; returns what counts then.

    The rows are the same before and after, and a failed or repeated run loses
    and doubles nothing: folders go only once the new list is written. Loads
    that aren't noted as written stay as they are. One compaction of a table at
    a time; readers that planned before it ended may miss the folders it deletes.
    """
    path = path.rstrip("/")
    now = loads(spark, path)
    noted = paths.names(spark, f"{path}/{LOADS}")
    written = {n.removeprefix("closed-") for n in noted if n.startswith("closed-")}
    closed = max([int(n[1:]) for n in written if n[0] == "b"], default=-1)
    folders = [(y, f.removeprefix("load_id=")) for y in paths.names(spark, path) if y.startswith("year=")
               for f in paths.names(spark, f"{path}/{y}") if f.startswith("load_id=")]
    there = {f for _, f in folders}
    fold = sorted(f for f in there if now.counts(f) and (f[0] == "c" or f in written or f[0] == "b" and int(f[1:]) <= closed))
    if len(fold) > 1 or any(f[:1] != "c" for f in fold):
        into = f"c{uuid.uuid4().hex[:12]}"
        df = spark.read.parquet(path).where(F.col("load_id").isin(fold)).drop("load_id")
        if not now.version:  # from here on readers leave out what isn't listed, such as the folders written next
            now = Loads(1)
            _listed(spark, path, now)
        # large years stay split, small ones become one file each
        _write(df.hint("rebalance", "year"), path, into, max_records_per_file)
        new = Loads(now.version + 1, (into,), max(now.folded_to, closed), tuple(f for f in there if f[0] == "l" and (f in fold or f in now.replaced)))
        if not _listed(spark, path, new):
            for year in {y for y, _ in folders}:
                paths.delete_folder(spark, f"{path}/{year}/load_id={into}")
            raise RuntimeError(f"another compaction of {path} ended first; nothing was folded")
        now = new
    for year, f in folders:
        if not now.counts(f):
            paths.delete_folder(spark, f"{path}/{year}/load_id={f}")
    old = {n for n in noted if n[0] == "v" and int(n[1:]) < now.version}
    old |= {f"closed-{f}" for f in written if f in now.replaced or f[0] == "b" and int(f[1:]) < closed}
    for n in sorted(old):  # older lists, and notes of loads that are folded
        paths.delete_folder(spark, f"{path}/{LOADS}/{n}")
    return now
