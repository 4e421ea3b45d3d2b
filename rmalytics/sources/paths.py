"""Small files and folders of a table, through the cluster's own file system."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing where there is no such folder."""
    system, at = _opened(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    system, at = _opened(spark, path)
    stream = system.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that others see whole or not at all; False where it is there already."""
    system, at = _opened(spark, path)
    if system.exists(at):
        return False
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    aside = hadoop(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex[:8]}")
    stream = system.create(aside, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    if system.rename(aside, at):
        return True
    system.delete(aside, False)
    return False


def delete_folder(spark: SparkSession, path: str) -> None:
    system, at = _opened(spark, path)
    system.delete(at, True)
