"""Continuous ingest: report files dropped into a landing folder.

The source application loads each uploaded report on request. Here a file
stream watches a landing folder and every micro-batch of new files goes
through the same batch ingest (scan, header check, typed projection) as an
upload. Only file *names* travel through the stream (the file source's
metadata, bounded by ``max_files_per_trigger``); the files themselves are
read by executors.

Exactly once: each micro-batch writes its rows under
``year=<y>/load_id=b<batch id>`` with dynamic partition overwrite, so a
batch replayed after a failure replaces its own output instead of adding
it twice. Batch loads may feed the same table, but no second stream;
``sources.tables.compact`` folds the loads of both. Rejected rows
(``on_error='quarantine'``) go to ``<table>_rejected`` first: files are
parsed once for both, into a persisted batch. With ``on_error='fail'`` a
bad row stops the query and the batch is retried on restart.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rmalytics.operators.ingest import enforce
from rmalytics.sources.reports import prepared_report
from rmalytics.sources.tables import close_batch, write_batch

_BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def report_stream(spark: SparkSession, landing_dir: str, table_path: str, kind: str = "returns",
                  checkpoint_dir: str | None = None, on_error: str = "quarantine",
                  file_glob: str = "*", max_files_per_trigger: int = 64,
                  available_now: bool = False, processing_time: str = "1 minute",
                  multiline: bool = True) -> StreamingQuery:
    """Start the stream; returns the running query.

    ``checkpoint_dir`` defaults to ``<table_path>_checkpoint``.
    ``available_now=True`` loads what is there and stops (useful for
    scheduled runs and tests). ``multiline=False`` lets large files be split.
    A file without the required columns is a rejected row of its own
    (``quarantine``) and doesn't hold up the others.
    """
    if kind not in ("returns", "sales"):
        raise ValueError("kind must be 'returns' or 'sales'")
    files = (spark.readStream.format("binaryFile")
             .schema(_BINARY_FILE_SCHEMA)
             .option("pathGlobFilter", file_glob)
             .option("maxFilesPerTrigger", max_files_per_trigger)
             .load(landing_dir)
             .select("path"))

    def load_batch(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(r.path for r in batch.collect())
        if not paths:
            return
        prepared = prepared_report(batch.sparkSession, kind, paths, on_error, multiline)
        if on_error == "quarantine":
            prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                good, bad = enforce(prepared, on_error)
                write_batch(bad.withColumn("_errors", F.array_join("_errors", "; ")), f"{table_path}_rejected", batch_id)
                write_batch(good, table_path, batch_id)
            finally:
                prepared.unpersist()
        else:
            write_batch(enforce(prepared, on_error), table_path, batch_id)
        close_batch(batch.sparkSession, table_path, batch_id)

    w = (files.writeStream.foreachBatch(load_batch)
         .option("checkpointLocation", checkpoint_dir or f"{table_path}_checkpoint"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
