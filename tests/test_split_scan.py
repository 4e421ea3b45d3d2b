"""Large report files by many tasks, and header records read without the rest of the file."""

import gzip
import os
import random

import numpy as np
import pytest

from rmalytics.schemas import RETURNS_HEADERS
from rmalytics.sources.records import ENTER, KEEP, LEAVE, SWAP, line_turn, report_files, states
from rmalytics.sources.reports import ReportHeaderError, ingest_returns, load_returns_report, read_report
from rmalytics.sources.tables import read_returns
from tests.test_ingest import returns_row, write_returns

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def split_bytes(spark):
    old = spark.conf.get(SPLIT)
    yield lambda n: spark.conf.set(SPLIT, str(n))
    spark.conf.set(SPLIT, old)


def quoted(v):
    return '"' + v.replace('"', '""') + '"'


def random_report(r, odd):
    """Fields with quoted tabs, newlines and quotes; with ``odd``, also quotes that no writer leaves so."""
    strange = ['"big" thing', '24" pipe', 'a"b"c', 'x""y', '"done"  ', '" lead"', '"a"""b"', ' "sp"']

    def field():
        v = "".join(r.choices(["a", "b", "é", " ", "\n", "\t", '"', "\r\n", "", "line"], k=r.randint(0, 5)))
        if odd and r.random() < 0.15:
            return r.choice(strange)
        return quoted(v) if any(c in v for c in '\t\n"\r') else v

    rows = [r.choice(["A\tB\tC", 'A\t"B\nb"\tC', '"A"\tB\tC'])]
    for _ in range(r.randint(5, 80)):
        rows.append("\t".join(field() for _ in range(3 if r.random() < 0.9 else r.randint(1, 4))))
        if r.random() < 0.05:
            rows.append("")
    end = r.choice(["\n", "\r\n"])
    return end.join(rows) + end


@pytest.mark.parametrize("seed", range(6))
def test_ranges_give_the_records_of_the_whole_file(spark, split_bytes, tmp_path, seed):
    r = random.Random(seed)
    text = random_report(r, odd=seed % 2 == 1)
    if seed == 5:
        text += 'x\t"never closed\nand more'
    path = str(tmp_path / "r.tsv")
    with open(path, "w", encoding="latin-1", newline="") as f:
        f.write(text)

    def rows(n):
        split_bytes(n)
        return sorted((tuple(x) for x in read_report(spark, path).collect()), key=str)

    whole = rows(1 << 27)
    for n in (24, 100, 700):  # a range may be shorter than a line
        assert rows(n) == whole
    split_bytes(100)
    if len(text) > 600:
        assert read_report(spark, path).rdd.getNumPartitions() > 4


def test_a_load_of_large_and_small_files(spark, split_bytes, tmp_path):
    folder = tmp_path / "in"
    name = 'a "quoted"\nname\twith é'
    write_returns(str(folder / "large.tsv"), [returns_row(**{"Item Name": name, "ASIN": f"A{k}"}) for k in range(60)], extra=["More"])
    write_returns(str(folder / "small.tsv"), [returns_row("1-Mar-24")], header=list(reversed(RETURNS_HEADERS)))
    with gzip.open(folder / "packed.tsv.gz", "wb") as f, open(folder / "large.tsv", "rb") as g:
        f.write(g.read())
    split_bytes(2000)
    table = str(tmp_path / "table")
    ingest_returns(spark, str(folder), table)
    rows = read_returns(spark, table).collect()
    assert len(rows) == 121 and sum(x.item_name == name for x in rows) == 120
    good, bad = load_returns_report(spark, str(folder), on_error="quarantine")
    assert good.count() == 121 and bad.count() == 0


def test_odd_file_names(spark, split_bytes, tmp_path):
    path = tmp_path / "a b" / "c%41 é+.tsv"
    path.parent.mkdir()
    path.write_bytes(b"A\tB\n" + b'"x\ny"\tz\n' * 40)
    split_bytes(50)
    rows = read_report(spark, str(path)).collect()
    assert [(x.A, x.B) for x in rows] == [("x\ny", "z")] * 40
    split_bytes(1 << 27)
    assert {x["_file"] for x in rows} == {x["_file"] for x in read_report(spark, str(path)).collect()}


def test_old_line_ends_are_read_whole(spark, split_bytes, tmp_path):
    path = str(tmp_path / "old.tsv")
    with open(path, "w", newline="") as f:
        f.write("A\tB\r" + "x\ty\r" * 50)
    split_bytes(40)
    assert [f.splits(40) for f in report_files(spark, path)] == [False]
    assert [tuple(x)[:2] for x in read_report(spark, path).collect()] == [("x", "y")] * 50


def behind(line, inside):
    """Whether a quoted field is open behind the line, character by character."""
    where, k = "quoted" if inside else "start", 0
    while k < len(line):
        c = line[k]
        if where == "quoted":
            if c == '"' and line[k + 1 : k + 2] == '"':
                k += 1
            elif c == '"':
                where = "plain"
        elif c == "\t":
            where = "start"
        else:
            where = "quoted" if where == "start" and c == '"' else "plain"
        k += 1
    return where == "quoted"


def test_what_a_line_does_to_the_state(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    lines = ["", '"', '""', '"""', "a", *("".join(r.choices('ab"""\t\r', k=r.randint(1, 14))) for _ in range(800))]
    turn_of = {(False, True): KEEP, (False, False): LEAVE, (True, True): ENTER, (True, False): SWAP}
    got = spark.createDataFrame([(x,) for x in lines], "l string").select("l", line_turn(F.col("l")).alias("turn")).collect()
    assert {x.turn for x in got} == {KEEP, LEAVE, ENTER, SWAP}
    for x in got:
        assert x.turn == turn_of[behind(x.l, False), behind(x.l, True)], x.l


def test_states_follow_the_turns():
    r = random.Random(3)
    step = {KEEP: lambda s: s, LEAVE: lambda s: 0, ENTER: lambda s: 1, SWAP: lambda s: 1 - s}
    for _ in range(300):
        turns, s = r.choices([KEEP, KEEP, LEAVE, ENTER, SWAP], k=r.randint(1, 12)), r.randint(0, 1)
        want, now = [], s
        for t in turns:
            now = step[t](now)
            want.append(now)
        assert states(np.array(turns), s).tolist() == want


def test_a_line_of_many_quotes_is_no_deep_recursion(spark):
    from pyspark.sql import functions as F

    lines = ['"' + 'x""' * 100_000, "\t".join(['"a"'] * 50_000), 'a"\t' * 50_000]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(line_turn(F.col("l"))).collect()
    turn_of = {(False, True): KEEP, (False, False): LEAVE, (True, True): ENTER, (True, False): SWAP}
    assert [x[0] for x in got] == [turn_of[behind(x, False), behind(x, True)] for x in lines]


# --- headers ----------------------------------------------------------------------


def test_headers_of_odd_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    texts = {"a": '"one\nname"\ttwo\r\nx\ty\r\n', "b": "\n\nfirst\tsecond\n", "c": "", "d": "\n\n", "e": "only", "f g%41": "x\tx\ty\n1\t2\t3\n"}
    for name, t in texts.items():
        (folder / name).write_bytes(t.encode("latin-1"))
    files = {os.path.basename(f.path): f for f in report_files(spark, str(folder))}
    assert files["a"].names == ("one\nname", "two") and files["a"].line_end == "\n"
    assert files["b"].names == ("first", "second")
    assert files["c"].names == () and files["c"].size == 0 and files["d"].names == ()
    assert files["e"].names == ("only",) and len(files) == 6
    assert files["f g%41"].names == ("x (column 1)", "x", "y")
    assert [tuple(x)[:2] for x in read_report(spark, str(folder / "b")).collect()] == []


def test_an_empty_file_fails_the_load_or_is_one_rejected_row(spark, tmp_path):
    folder = tmp_path / "in"
    write_returns(str(folder / "good.tsv"), [returns_row()])
    (folder / "empty.tsv").write_bytes(b"")
    table = str(tmp_path / "table")
    with pytest.raises(ReportHeaderError):
        ingest_returns(spark, str(folder / "empty.tsv"), table)
    with pytest.raises(ReportHeaderError):
        ingest_returns(spark, str(folder), table)
    assert not os.path.exists(table)
    bad = ingest_returns(spark, str(folder), table, on_error="quarantine").collect()
    assert len(bad) == 1 and bad[0]["_file"].endswith("empty.tsv") and "empty" in bad[0]["_errors"][0]
    assert read_returns(spark, table).count() == 1


def test_bytes_read_for_headers_do_not_grow_with_the_file(spark, tmp_path):
    """Spark's scan isn't used, and what is taken from the stream ends with the header."""
    import io

    from rmalytics.sources import records

    path = tmp_path / "large.tsv"
    path.write_bytes(b"A\tB\n" + b"some text\tof a line\n" * 400_000)
    jobs = []
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        assert report_files(spark, str(path))[0].names == ("A", "B")
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1  # no second job, which would scan the file
    stream = io.BytesIO(path.read_bytes())
    assert records._header(records._first_lines(stream))[0] == b"A\tB"
    assert stream.tell() == records.READ_BYTES


def test_files_that_only_spark_opens_are_scanned(spark, tmp_path, monkeypatch):
    from rmalytics.sources import records

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_bytes(b'\n"x\ny"\tz\r\n1\t2\r\n')
    (folder / "b").write_bytes(b"")
    want = report_files(spark, str(folder))

    def none(batches):
        for batch in batches:
            yield records._header_rows([(u, None, None, None, None) for u in batch.column(0).to_pylist()])

    monkeypatch.setattr(records, "_headers_by_range", none)
    assert report_files(spark, str(folder)) == want
