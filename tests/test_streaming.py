import random

from pyspark.sql import functions as F

from logtrail.operators.windows import greedy_windows, window_members
from logtrail.streaming.bursts import burst_stream
from logtrail.streaming.ingest import ingest, ingested


def drain(stream, tmp_path, name):
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .start(str(tmp_path / name))
    )
    query.awaitTermination()


def test_ingest_takes_each_file_once(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / n) for n in ("in", "events", "checkpoint"))
    (tmp_path / "in").mkdir()
    now = F.lit("2026-05-01 00:00:00").cast("timestamp")
    (tmp_path / "in" / "a.log").write_text("Apr 10 08:00:00 h sshd[1]: Failed password for bob from 10.0.0.9 port 22\n")
    ingest(spark, landing, table, checkpoint, 2026, ingest_ts=now).awaitTermination()
    (tmp_path / "in" / "b.log").write_text("Apr 10 08:00:01 h app: one\nApr 10 08:00:02 h app: two\n")
    for _ in range(2):
        ingest(spark, landing, table, checkpoint, 2026, ingest_ts=now).awaitTermination()
    rows = ingested(spark, table).orderBy("timestamp").collect()
    assert [(r.source_file.rsplit("/", 1)[1], r.username) for r in rows] == [("a.log", "bob"), ("b.log", ""), ("b.log", "")]


def test_a_file_delivered_again_is_taken_once(spark, tmp_path):
    text = 'time,message\n2026-04-10T08:00:00Z,"one\n\nstill ""one"""\n2026-04-10T08:00:01Z,two\n'
    for folder, body in (("x", text), ("y", text.replace("two", "2nd"))):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "a.csv").write_text(body)
    landing, checkpoint = str(tmp_path / "in"), str(tmp_path / "c")
    how = {"csv_header": ["time", "message"], "recursiveFileLookup": True}
    got = {}
    for same in ("path", "name_and_size"):
        table = str(tmp_path / same)
        ingest(spark, landing, table, f"{checkpoint}-{same}", same_file=same, **how).awaitTermination()
        got[same] = sorted(r.message for r in ingested(spark, table).collect())
    assert got["path"] == sorted(['one\n\nstill "one"', "two"] + ['one\n\nstill "one"', "2nd"])
    assert got["name_and_size"] == sorted(['one\n\nstill "one"', "two"])
    (tmp_path / "in" / "z").mkdir()
    (tmp_path / "in" / "z" / "a.csv").write_text(text)  # a later batch brings it once more, and a new file
    (tmp_path / "in" / "z" / "b.csv").write_text("time,message\n2026-04-10T08:00:02Z,three\n")
    ingest(spark, landing, str(tmp_path / "name_and_size"), f"{checkpoint}-name_and_size", same_file="name_and_size", **how).awaitTermination()
    assert sorted(r.message for r in ingested(spark, str(tmp_path / "name_and_size")).collect()) == sorted([*got["name_and_size"], "three"])


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("Apr 10 08:00:00 h app: one\n")
    landing, table, checkpoint = (str(tmp_path / n) for n in ("in", "events", "checkpoint"))
    ingest(spark, landing, table, checkpoint, 2026).awaitTermination()
    # the batch was done but its commit was lost: it is planned and run a second time
    for commit in (tmp_path / "checkpoint" / "commits").iterdir():
        commit.unlink()
    (tmp_path / "in" / "b.log").write_text("Apr 10 08:00:01 h app: two\n")
    ingest(spark, landing, table, checkpoint, 2026).awaitTermination()
    assert sorted(r.message for r in ingested(spark, table).collect()) == ["[app] one", "[app] two"]


def test_csv_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Time;Message\n2026-04-10T08:00:00Z; via App Mail ok\n")
    ingest(
        spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), csv_header=["Time", "Message"], delimiter=";"
    ).awaitTermination()
    (row,) = ingested(spark, str(tmp_path / "t")).collect()
    assert (row.process, row.message, str(row.timestamp)) == ("Mail", "via App Mail ok", "2026-04-10 08:00:00")


def test_stream_windows_equal_batch_windows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(3)}", t, i) for i, t in enumerate(sorted(rng.sample(range(4000), 300)))]
    df = spark.createDataFrame(rows, "key string, s long, event_idx long").select(
        "key", F.timestamp_seconds("s").alias("timestamp"), "event_idx"
    )
    batch = df.withColumn("t", F.unix_micros("timestamp"))
    expected = window_members(batch, greedy_windows(batch, 60, 4), 60).groupBy("key", "start").agg(F.count("*").alias("n"))
    # Several files in shuffled order: rows come up to 100 s late, within the allowed lateness.
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(100))
    for i in range(3):
        part = order[i * 100 : (i + 1) * 100]
        spark.createDataFrame(part, "key string, s long, event_idx long").select(
            "key", F.timestamp_seconds("s").alias("timestamp"), "event_idx"
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([("end", 900_000, -1)], "key string, s long, event_idx long")
    end.select("key", F.timestamp_seconds("s").alias("timestamp"), "event_idx").coalesce(1).write.mode("append").parquet(
        str(tmp_path / "in")
    )
    stream = (
        spark.readStream.schema("key string, timestamp timestamp, event_idx long")
        .option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "in"))
    )
    drain(burst_stream(stream, 60, 4, lateness="1 hour"), tmp_path, "out")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.key, r.start_us, r.n) for r in got.collect()} == {(r.key, r.start, r.n) for r in expected.collect()}
    assert got.count() > 5


def events_of(spark, rows):
    return spark.createDataFrame(rows, "key string, s long, event_idx long").select("key", F.timestamp_seconds("s").alias("timestamp"), "event_idx")


def land(spark, tmp_path, *deliveries):
    for rows in deliveries:
        events_of(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "key string, timestamp timestamp, event_idx long"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_many_keys_share_few_states(spark, tmp_path):
    keys = 3000
    parts = [[(f"k{k}", 1000 * n + k % 7, keys * n + k) for k in range(keys)] for n in range(2)]
    stream = burst_stream(land(spark, tmp_path, *parts, [("end", 90_000, -1)]), 1100, 2, lateness="1 second")
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(held) < keys  # rows of the windows' state: by groups of keys, not by key
    got = {(r.key, r.start_us, r.last_us, r.n, r.first_idx) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(f"k{k}", k % 7 * 1_000_000, (1000 + k % 7) * 1_000_000, 2, k) for k in range(keys)}


def test_groups_of_keys_equal_batch_windows(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"k{min(rng.randrange(40), rng.randrange(400))}", s, i) for i, s in enumerate(sorted(rng.choices(range(6000), k=1500)))]
    few = [("few", 10, 9001), ("few", 11, 9002), ("few", 12, 9003)]  # fewer rows than the threshold
    late = sorted(rows + few, key=lambda r: r[1] + rng.randrange(300))
    stream = land(spark, tmp_path, late[:500], late[500:1000], late[1000:], [("end", 900_000, -1)])
    drain(burst_stream(stream, 600, 5, lateness="20 minutes", slot="1 minute", groups=3), tmp_path, "out")
    batch = events_of(spark, rows + few).withColumn("t", F.unix_micros("timestamp"))
    members = window_members(batch, greedy_windows(batch, 600, 5), 600)
    expected = members.groupBy("key", "start").agg(F.max("t"), F.count("*"), F.min("event_idx"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in expected.collect()) and len(got) > 20


def test_a_window_waits_for_the_slot_of_its_end(spark, tmp_path):
    # the watermark, 75, is past the window's end, 70, but the row at 65 is in a slot that ends at 120
    stream = land(spark, tmp_path, [("a", 40, 1), ("a", 45, 2), (None, 41, 3), (None, 42, 4)], [("b", 85, 5), ("a", 80, 6)], [("a", 65, 7)], [("end", 90_000, -1)])
    drain(burst_stream(stream, 30, 2, lateness="10 seconds", slot="1 minute"), tmp_path, "out")
    got = {(r.key, r.start_us // 1_000_000, r.last_us // 1_000_000, r.n, r.first_idx) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 40, 65, 3, 1), (None, 41, 42, 2, 3)}
