"""Loads of batches and streams in one table, folded without loss or doubles."""

import os

import pytest
from pyspark.sql import functions as F

from rmalytics.sources import paths, tables
from rmalytics.sources.reports import ingest_returns
from rmalytics.sources.tables import Loads, append_table, close_batch, compact, loads, read_returns, write_batch
from tests.test_ingest import returns_row, write_returns


def rows(spark, values, year=2024):
    df = spark.createDataFrame([(f"A{v}", f"S{v}", v) for v in values], "asin string, merchant_sku string, return_quantity int")
    return df.withColumns({"return_reason": F.lit("r"), "year": F.lit(year), "month_no": F.lit(1), "month": F.lit("January")})


def quantities(spark, path):
    return sorted(x.return_quantity for x in read_returns(spark, path).collect())


def folders(path):
    return sorted(f for y in os.listdir(path) if y.startswith("year=") for f in os.listdir(f"{path}/{y}") if f.startswith("load_id="))


def test_batches_and_stream_feed_one_table(spark, tmp_path):
    path = str(tmp_path / "t")
    append_table(rows(spark, [1, 2]), path)
    for b in range(3):
        write_batch(rows(spark, [10 + b], 2023 + b % 2), path, b)
        close_batch(spark, path, b)
    append_table(rows(spark, [3]), path)
    want = quantities(spark, path)
    assert want == [1, 2, 3, 10, 11, 12] and len(folders(path)) == 5
    now = compact(spark, path)
    assert quantities(spark, path) == want
    assert folders(path) == [f"load_id={now.compacted[0]}"] * 2 and now.folded_to == 2
    years = [f for f in os.listdir(path) if f.startswith("year=")]
    assert sorted(years) == ["year=2023", "year=2024"]
    assert compact(spark, path) == now  # nothing to do
    append_table(rows(spark, [4]), path)
    write_batch(rows(spark, [13]), path, 3)
    close_batch(spark, path, 3)
    compact(spark, path)
    assert quantities(spark, path) == sorted([*want, 4, 13]) and len(folders(path)) == 2
    assert len(os.listdir(f"{path}/{tables.LOADS}")) < 8


def test_a_replay_during_or_after_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for b in range(3):
        write_batch(rows(spark, [b, b + 10]), path, b)
        close_batch(spark, path, b)
    want = quantities(spark, path)
    real, seen = paths.write_text, []

    def write_text(s, p, text):
        if "/v" in p and '["c' in text:  # the compacted rows are written, the list isn't: a replay, and a reader
            write_batch(rows(spark, [2, 12]), path, 2)
            seen.append(quantities(spark, path))
        return real(s, p, text)

    monkeypatch.setattr(paths, "write_text", write_text)
    compact(spark, path)
    monkeypatch.setattr(paths, "write_text", real)
    assert seen == [want] and quantities(spark, path) == want
    write_batch(rows(spark, [1, 11]), path, 1)  # after it
    assert quantities(spark, path) == want and len(folders(path)) == 2
    compact(spark, path)
    assert quantities(spark, path) == want and len(folders(path)) == 1


@pytest.mark.parametrize("step", ["list", "delete"])
def test_a_failed_compaction_is_made_good_by_the_next(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    for k in range(3):
        append_table(rows(spark, [k]), path)
    real = getattr(paths, "write_text" if step == "list" else "delete_folder")

    def fails(s, p, *a):
        if step == "delete" or "/v" in p and '["c' in a[0]:
            raise OSError("lost")
        return real(s, p, *a)

    monkeypatch.setattr(paths, real.__name__, fails)
    with pytest.raises(OSError):
        compact(spark, path)
    monkeypatch.setattr(paths, real.__name__, real)
    assert quantities(spark, path) == [0, 1, 2] and len(folders(path)) == 4
    append_table(rows(spark, [3]), path)
    assert quantities(spark, path) == [0, 1, 2, 3]
    compact(spark, path)
    assert quantities(spark, path) == [0, 1, 2, 3] and len(folders(path)) == 1


def test_loads_that_are_not_closed_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    append_table(rows(spark, [1]), path)
    write_batch(rows(spark, [2]), path, 0)
    close_batch(spark, path, 0)
    write_batch(rows(spark, [3]), path, 1)  # not closed: it may be written anew
    tables._write(tables.with_stored_keys(rows(spark, [4])), path, "l0000", 100)  # a load whose note is missing
    compact(spark, path)
    assert quantities(spark, path) == [1, 2, 3, 4]
    assert [f for f in folders(path) if "=c" not in f] == ["load_id=b000000001", "load_id=l0000"]
    write_batch(rows(spark, [3, 5]), path, 1)
    assert quantities(spark, path) == [1, 2, 3, 4, 5]


def test_folders_stay_few_over_200_batches(spark, tmp_path):
    path, most = str(tmp_path / "t"), 0
    for b in range(200):
        # as a micro-batch writes it, without a job for each
        folder = f"{path}/year=2024/load_id={tables.batch_load(b)}"
        if b == 0:
            write_batch(rows(spark, [0]), path, 0)
            source = next(f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet"))
            with open(source, "rb") as f:
                part = f.read()
        else:
            os.makedirs(folder)
            with open(f"{folder}/part-0.parquet", "wb") as f:
                f.write(part)
        close_batch(spark, path, b)
        if b % 50 == 49:
            compact(spark, path)
            most = max(most, len(folders(path)))
    assert most == 1 and read_returns(spark, path).count() == 200
    assert len(os.listdir(f"{path}/{tables.LOADS}")) < 8
    assert loads(spark, path).folded_to == 199


def test_folded_loads_are_pruned_as_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(2):
        append_table(rows(spark, [k]), path)
    compact(spark, path)
    append_table(rows(spark, [7]), path)
    plan = read_returns(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "load_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_which_loads_count():
    now = Loads(3, ("c1",), 4, ("l1",))
    assert [x for x in ("c1", "c2", "b000000004", "b000000005", "l1", "l2") if now.counts(x)] == ["c1", "b000000005", "l2"]


def test_ingest_twice_and_fold(spark, tmp_path):
    p = write_returns(str(tmp_path / "r.tsv"), [returns_row(), returns_row("1-Mar-23", "4")])
    table = str(tmp_path / "table")
    for _ in range(2):
        ingest_returns(spark, p, table)
    compact(spark, table)
    t = read_returns(spark, table)
    assert t.count() == 4 and t.agg(F.sum("return_quantity")).first()[0] == 12
    assert sorted({(x.year, x.month) for x in t.collect()}) == [(2023, "March"), (2024, "January")]


def test_a_stream_parses_each_file_once(spark, tmp_path, monkeypatch):
    """Rejected rows are written first, from the same persisted batch."""
    import rmalytics.streaming.report_stream  # noqa: F401
    import sys
    module = sys.modules["rmalytics.streaming.report_stream"]
    from rmalytics.streaming.report_stream import report_stream

    order, parsed = [], []
    real_write, real_prepare = module.write_batch, module.prepared_report
    monkeypatch.setattr(module, "write_batch", lambda df, path, b: (order.append((path.endswith("_rejected"), df.storageLevel.useMemory or "InMemory" in df._jdf.queryExecution().executedPlan().toString())), real_write(df, path, b)))
    monkeypatch.setattr(module, "prepared_report", lambda *a: parsed.append(a[2]) or real_prepare(*a))
    landing, table = str(tmp_path / "landing"), str(tmp_path / "table")
    write_returns(f"{landing}/a.tsv", [returns_row("5-Jan-24", "2"), returns_row("6-Jan-24", "x")])
    q = report_stream(spark, landing, table, available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None
    assert order == [(True, True), (False, True)] and len(parsed) == 1
    assert read_returns(spark, table).count() == 1
    append_table(read_returns(spark, table).drop("load_id"), table)
    compact(spark, table)
    assert read_returns(spark, table).count() == 2
