"""Files that cannot be read, records over splits, records that cannot be normalised, and complete runs."""

import csv
import gzip
import random

import pytest
from pyspark.sql import functions as F

from logtrail.functions.times import DATE_RANGE, EPOCH_INFINITE, EPOCH_RANGE, epoch_error, iso_error
from logtrail.sinks import read_results
from logtrail.sources.csv import read_csv
from logtrail.sources.isolate import read_isolated
from logtrail.sources.router import list_files, read_logs
from logtrail.sources.winevent import read_windows_events


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": str(1 << 20), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_unreadable_files_are_rejected_and_the_others_read(spark, tmp_path):
    lines = "2026-04-10T08:00:00Z host app: hello\n" * 300
    packed = gzip.compress(lines.encode())
    for k in range(12):
        (tmp_path / f"ok{k}.log").write_text(lines)
    (tmp_path / "fine.log.gz").write_bytes(packed)
    (tmp_path / "cut.log.gz").write_bytes(packed[:-20])
    (tmp_path / "junk.LOG.gz").write_bytes(b"no archive")
    (tmp_path / "more.csv").write_text("time,message\n2026-04-10T08:00:02Z,three\n")
    (tmp_path / "junk.csv.gz").write_bytes(b"no archive")
    (tmp_path / "junk.parquet").write_bytes(b"no table")
    (tmp_path / "a b.log").write_text(lines)
    (tmp_path / "x.pcapng.gz").write_bytes(b"x")
    found = read_logs(spark, str(tmp_path), 2026)
    rejected = {r.path.rsplit("/", 1)[1]: r.reason for r in found.rejected.collect()}
    assert sorted(rejected) == ["cut.log.gz", "junk.LOG.gz", "junk.csv.gz", "junk.parquet", "x.pcapng.gz"]
    assert "EOFException" in rejected["cut.log.gz"] and "not a gzip file" in rejected["junk.csv.gz"] and "not a Parquet file" in rejected["junk.parquet"]
    counts = {r.source_file: r.records for r in found.file_counts().collect()}
    assert counts == {f"ok{k}.log": 300 for k in range(12)} | {"fine.log.gz": 300, "more.csv": 1, "a b.log": 300}
    assert found.failed == [] and found.union().count() == 14 * 300 + 1


def test_only_errors_of_files_are_isolated(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\n")
    files = list_files(spark, str(tmp_path))

    def broken(keep):
        raise RuntimeError("no space left on device")

    with pytest.raises(RuntimeError):
        read_isolated(files, broken, "none")


def test_csv_records_over_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    rows = []
    for k in range(16_000):
        text = rng.choice(["plain", 'with "quotes"', "two\nlines", 'three\n\n"quoted"\nlines, and more', "", "x" * 300])
        rows.append([str(k), text, rng.choice(["", "tail", "a,b"])])
    # one cell that covers several whole splits, and one that begins right after it
    rows[5000][1] = "\n".join(f"line {k} of a long cell" for k in range(120_000))
    rows[5001][1] = "next\nto it"
    with open(tmp_path / "big.csv", "w", newline="") as file:
        writer = csv.writer(file, lineterminator="\n")
        writer.writerow(["Id", "Text", "Last"])
        writer.writerows(rows)
    (tmp_path / "small.csv").write_text("Id,Text,Last\n-1,one,\n")
    (frame, *others) = read_csv(spark, str(tmp_path))
    assert (tmp_path / "big.csv").stat().st_size > 4 << 20
    whole = frame if not others else frame.unionByName(others[0])
    got = {r.id: (r.text, r.last, r.row_no) for r in whole.filter("source_file = 'big.csv'").collect()}
    assert {i: v[:2] for i, v in got.items()} == {i: (t.strip(), last) for i, t, last in rows}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1][2])] == [i for i, *_ in rows]
    assert whole.filter("id = '-1'").count() == 1
    assert spark.read.text(str(tmp_path / "big.csv")).rdd.getNumPartitions() > 4


def test_xml_elements_over_splits(spark, tmp_path, small_splits):
    event = '<Event xmlns="e"><System><EventID>%d</EventID><Computer>c</Computer></System><EventData><Data Name="T">%s</Data></EventData></Event>\n'
    rng = random.Random(2)
    parts = [event % (k, "y" * rng.randrange(400)) for k in range(12_000)]
    parts[700] = event % (700, "z" * (3 << 20))  # longer than a split
    parts[900] = parts[900].replace("</Event>", "")  # has no end: only this one is lost
    (tmp_path / "big.xml").write_text("<?xml version='1.0'?>\n<Events>\n" + "".join(parts) + "</Events>\n")
    records = read_windows_events(spark, str(tmp_path))
    assert records.rdd.getNumPartitions() > 4
    rows = records.select("event_id", "row_no", F.length(F.col("event_data")["T"]).alias("n")).orderBy("row_no").collect()
    assert [r.event_id for r in rows] == ["parse_error" if k == 900 else str(k) for k in range(12_000)]
    assert rows[700].n == 3 << 20


def test_times_that_no_calendar_holds(spark):
    texts = ["0001-01-01T00:00:00+14:00", "9999-12-31T23:59:59-01:00", "0001-01-02T00:00:00Z", "inf", "-Infinity", "1e400", "1e30", "-9.3e18", "9.3e18", "9.3e21", "1712011200", "x", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("t", F.coalesce(iso_error(F.col("t")), epoch_error(F.col("t"))).alias("e")).orderBy("k").collect()
    assert [r.e for r in got] == [DATE_RANGE, DATE_RANGE, None, EPOCH_INFINITE, EPOCH_INFINITE, EPOCH_INFINITE, EPOCH_RANGE, EPOCH_RANGE, None, EPOCH_RANGE, None, None, None]


def test_no_complete_run_is_an_error(spark, tmp_path):
    spark.createDataFrame([], "run_id string, finished timestamp, events long, alerts long").write.parquet(f"{tmp_path}/runs")
    with pytest.raises(ValueError, match="no complete run"):
        read_results(spark, str(tmp_path))
