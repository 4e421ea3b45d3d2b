"""Scratch folder rules: the session's spark.checkpoint.dir, unique folders."""

from rmalytics.session import scratch_path, shared_dir


def test_shared_dir_is_the_sessions_checkpoint_dir(spark):
    d = shared_dir(spark)
    ckpt = spark.sparkContext.getCheckpointDir()
    assert ckpt and d == ckpt.rstrip("/")


def test_scratch_paths_are_unique_and_under_shared_dir(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b
    assert a.startswith(shared_dir(spark) + "/rmalytics-x-")


def test_cluster_without_checkpoint_dir_is_refused():
    """No machine-local fallback on a cluster master."""
    import pytest

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key):
                raise KeyError(key)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_scratch_folders_go_at_the_end_and_nothing_else_does(tmp_path):
    """In a process of its own: on request, and at its end, after the session was stopped."""
    import os
    import subprocess
    import sys

    code = f"""
import os
from rmalytics.session import clear_scratch, local_session, scratch_path, shared_dir
spark = local_session(1, **{{"spark.checkpoint.dir": "{tmp_path}", "spark.driver.memory": "1g"}})
shared = shared_dir(spark).removeprefix("file:")
os.mkdir(shared + "/rmalytics-x-other")
os.mkdir(shared + "/kept")
a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
spark.range(3).write.parquet(a)
spark.range(3).write.parquet(a + "-beside")
assert len(os.listdir(shared)) == 4
assert clear_scratch() == [] and len(os.listdir(shared)) == 2
c = scratch_path(spark, "y")
spark.range(3).write.parquet(c)
assert len(os.listdir(shared)) == 3
spark.stop()
print(c)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=300, capture_output=True, text=True)
    assert "rmalytics-y-" in done.stdout
    (shared,) = os.listdir(tmp_path)
    assert sorted(os.listdir(tmp_path / shared)) == ["kept", "rmalytics-x-other"]


def test_tables_are_loaded_anew_after_clearing(spark):
    from rmalytics.plans.registry import QUERIES
    from rmalytics.session import clear_scratch

    first = QUERIES["yearly_total"](spark, "/root/testdata/sf0.001").collect()
    assert clear_scratch() == []
    assert QUERIES["yearly_total"](spark, "/root/testdata/sf0.001").collect() == first
