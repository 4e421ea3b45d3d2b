"""Load the driver's tables into the two stored report tables.

The source application answers every question from two stored tables; so
does this one. ``tables(spark, sf_dir)`` derives `returns` and `sales` from
the driver's Parquet once per Spark application and source folder, writes
them under the shared scratch folder (``spark.checkpoint.dir``), Parquet
partitioned by ``year``, and hands back DataFrames reading them. Queries then
prune partitions by year and read only the columns they use.
"""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from rmalytics.session import SCRATCH, scratch_path
from rmalytics.sources.driver import returns_view, sales_view
from rmalytics.sources.tables import append_table, read_returns, read_sales

_lock = threading.Lock()
_loaded: dict[tuple[str, int, str], tuple[str, str]] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, int, str]:
    return spark.sparkContext.applicationId, SCRATCH.epoch, sf_dir.rstrip("/")


def load(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Write both tables (if not yet done in this application); return paths."""
    key = _key(spark, sf_dir)
    with _lock:
        if key not in _loaded:
            base = scratch_path(spark, "tables")
            rp, sp = f"{base}/returns", f"{base}/sales"
            # two independent jobs; the scheduler runs them side by side
            with ThreadPoolExecutor(max_workers=2) as pool:
                jobs = [pool.submit(append_table, returns_view(spark, sf_dir), rp),
                        pool.submit(append_table, sales_view(spark, sf_dir), sp)]
                for j in jobs:
                    j.result()
            _loaded[key] = (rp, sp)
        return _loaded[key]


_frames: dict[tuple[SparkSession, int, str], tuple[DataFrame, DataFrame]] = {}


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """DataFrames over the two tables. The tables never change once written,
    so one pair (with its listed file index) serves every plan."""
    key = (spark, SCRATCH.epoch, sf_dir.rstrip("/"))  # files per application, DataFrames per session
    with _lock:
        frames = _frames.get(key)
    if frames is None:
        rp, sp = load(spark, sf_dir)
        frames = (read_returns(spark, rp), read_sales(spark, sp))
        with _lock:
            frames = _frames.setdefault(key, frames)
    return frames
