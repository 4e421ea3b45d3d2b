"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "rmalytics", **conf) -> SparkSession:
    """A local session configured like the cluster one: AQE on, UTC, no UI."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(os.cpu_count() if cpus == "*" else cpus))
        .config("spark.driver.memory", "16g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder (``spark.checkpoint.dir``).

    Read from the session. Only a local-mode session without one (tests,
    bench) gets a fresh folder of its own; on a cluster a missing setting is
    an error, since a machine-local folder is not visible to executors.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            d = None
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="rmalytics-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d.rstrip("/")


class ScratchFolders:
    """The scratch folders that this process made: deleted on request, or when it ends.

    Nothing else is ever deleted: only names that ``path`` gave out, each with
    a part of its own. A process that is killed leaves its folders.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._made: list[tuple] = []  # (JVM view, Hadoop settings, path)
        self.epoch = 0  # how often folders were cleared: what was kept in them is gone

    def path(self, spark: SparkSession, kind: str) -> str:
        path = f"{shared_dir(spark)}/rmalytics-{kind}-{uuid.uuid4().hex[:12]}"
        with self._lock:
            # held for the end, when the session may have been stopped
            self._made.append((spark._jvm, spark._jsc.hadoopConfiguration(), path))
        return path

    def clear(self) -> list[str]:
        """Deletes the folders; frames that read them can't be used any more. Returns those that are left."""
        with self._lock:
            made, self._made = self._made, []
            self.epoch += 1
        left = []
        for jvm, conf, path in made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            system = at.getFileSystem(conf)
            # tables written beside a folder, such as <folder>-placed, carry its name
            for status in system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}*")) or []:
                if not system.delete(status.getPath(), True):
                    left.append(path)
        return left

    def clear_at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            self.clear()


SCRATCH = ScratchFolders()
atexit.register(SCRATCH.clear_at_exit)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new, unique folder name under the shared scratch folder, deleted when this process ends."""
    return SCRATCH.path(spark, kind)


def clear_scratch() -> list[str]:
    """Deletes this process's scratch folders now."""
    return SCRATCH.clear()
