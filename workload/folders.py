"""Folders of log files of all formats: reading, rejects, records that cannot be normalised, written results."""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.operators.normalize import normalize_csv, normalize_packets, normalize_syslog, normalize_windows
from logtrail.plans.correlate import analyze
from logtrail.sinks import read_results, write_results
from logtrail.sources.packets import derive_packet_fields
from logtrail.sources.router import read_logs
from logtrail.sources.syslog import parse_syslog
from workload.base import LOGS, logs, query
from workload.parsing import YEAR, ingest_ts, packets, scratch, windows_records

# --- records that cannot be normalised ---------------------------------------------------------

_BAD_DATE = "0001-01-01T00:00:00+14:00"
_BAD_TIME = f"CASE event_idx % 11 WHEN 0 THEN '1e30' WHEN 1 THEN 'inf' WHEN 2 THEN '{_BAD_DATE}' ELSE '2024-01-05T06:07:08Z' END"


@query(
    f"""WITH {LOGS}, made AS (
        SELECT 'csv' AS kind, event_idx AS row_no, CASE event_idx % 11 WHEN 0 THEN 'timestamp out of range for platform time_t'
            WHEN 1 THEN 'cannot convert float infinity to integer' WHEN 2 THEN 'date value out of range' END AS reason FROM logs
        UNION ALL SELECT 'syslog', event_idx, CASE WHEN event_idx % 11 = 2 THEN 'date value out of range' END FROM logs
        UNION ALL SELECT 'windows', event_idx, CASE WHEN event_idx % 11 = 2 THEN 'date value out of range' END FROM logs
        UNION ALL SELECT 'packets', event_idx, CASE WHEN event_idx % 9 = 0 THEN 'payload size is not a number' END FROM logs)
    SELECT kind, row_no, CASE WHEN reason IS NULL THEN '' ELSE 'PARSE_ERROR' END AS event_id,
        coalesce('Normalization error: ' || reason, '') AS message, CASE WHEN reason IS NULL THEN '' ELSE 'system/low' END AS class,
        CASE WHEN reason IS NULL THEN '' ELSE kind || '.in' END AS source, reason IS NULL OR kind = 'packets' AS timed FROM made"""
)
def parse_errors(spark, sf_dir):
    """Records of all four formats, some of which cannot be normalised: those are events of their file."""
    rows = logs(spark, sf_dir)
    origin = {"file_seq": F.lit(0), "row_no": F.col("event_idx")}
    csv = rows.select(F.expr(_BAD_TIME).alias("timestamp"), "message", F.lit("csv.in").alias("source_file"), *[c.alias(n) for n, c in origin.items()])
    bad_day = f"CASE WHEN event_idx % 11 = 2 THEN '{_BAD_DATE}' ELSE '2024-01-05T06:07:08Z' END"
    line = F.concat(F.expr(bad_day), F.lit(" host app: "), F.col("message"))
    lines = rows.select(line.alias("value"), F.lit("syslog.in").alias("source_file"), *[c.alias(n) for n, c in origin.items()])
    windows = windows_records(spark, sf_dir).withColumns(
        {"ts_raw": F.expr(bad_day.replace("event_idx", "row_no")), "source_file": F.lit("windows.in")}
    )
    frames = {
        "csv": normalize_csv(csv, ingest_ts()),
        "syslog": normalize_syslog(parse_syslog(lines, YEAR, ingest_ts())),
        "windows": normalize_windows(windows, ingest_ts()),
        "packets": normalize_packets(derive_packet_fields(packets(spark, sf_dir).withColumn("source_file", F.lit("packets.in")))),
    }
    failed = F.col("event_id") == "PARSE_ERROR"
    out = None
    for kind, frame in frames.items():
        seen = frame.select(
            F.lit(kind).alias("kind"),
            "row_no",
            *[F.when(failed, c).otherwise("").alias(n) for n, c in (("event_id", F.col("event_id")), ("message", F.col("message")), ("class", F.concat_ws("/", "category", "severity")), ("source", F.col("source")))],
            F.col("timestamp").isNotNull().alias("timed"),
        )
        out = seen if out is None else out.unionByName(seen)
    return out


# --- a folder of all formats, with files that cannot be read -----------------------------------


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _named(spark: SparkSession, folder: str, stem: str) -> None:
    """Give the files that a write left in a folder plain names, the same in every folder."""
    where, fs = _hadoop(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-"))
    for k, name in enumerate(names):
        extension = name[name.index(".") :] if ".c000." not in name else name[name.index(".c000.") + 5 :]
        fs.rename(_hadoop(spark, f"{folder}/{name}")[0], _hadoop(spark, f"{folder}/{stem}-{k}{extension}")[0])


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    where, fs = _hadoop(spark, path)
    out = fs.create(where)
    out.write(bytearray(data))
    out.close()


def mixed_folder(spark: SparkSession, sf_dir: str) -> str:
    """Logs of two hosts in all formats, under equal names; and files that no reader takes or can read."""
    root = scratch(spark, "mixed")
    rows = logs(spark, sf_dir)
    time = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    for host in (0, 1):
        mine = rows.filter(F.col("user_id") % 2 == host)
        text = F.when(F.col("event_idx") % 3 == 0, F.concat("message", F.lit(', then\na second "line"'))).otherwise(F.col("message"))
        logins = mine.filter("event_type IN ('error', 'signup')").select(
            time.alias("Time"), F.col("event_id").alias("Event ID"), "category", "severity", "source_ip", "username", text.alias("Message")
        )
        logins.write.options(header=True, escape='"').csv(f"{root}/host{host}/csv")
        _named(spark, f"{root}/host{host}/csv", "events")
        sudo = F.concat(time, F.lit(" "), "hostname", F.lit(" sudo: "), "username", F.lit(" : TTY=pts/0 ; USER=root ; COMMAND=/bin/run "), "event_idx")
        lines = mine.filter("event_type = 'purchase'").select(sudo.alias("value"))
        lines.write.options(**({"compression": "gzip"} if host else {})).text(f"{root}/host{host}/syslog")
        _named(spark, f"{root}/host{host}/syslog", "auth")
        item = F.struct(F.col("username").alias("_VALUE"), F.lit("TargetUserName").alias("_Name"))
        system = F.struct(
            F.struct(F.col("event_id").alias("_VALUE"), F.lit("0").alias("_Qualifiers")).alias("EventID"),
            F.struct(time.alias("_SystemTime")).alias("TimeCreated"),
            F.lit("Security").alias("Channel"),
            F.col("hostname").alias("Computer"),
        )
        views = mine.filter("event_type = 'view'").select(system.alias("System"), F.struct(F.array(item).alias("Data")).alias("EventData"))
        views.write.format("xml").options(rowTag="Event", rootTag="Events").save(f"{root}/host{host}/windows")
        _named(spark, f"{root}/host{host}/windows", "security")
        wire = mine.filter("event_type = 'click'").select(
            F.date_trunc("second", "timestamp").alias("timestamp"), F.col("source_ip").alias("src_ip"), F.col("dest_ip").alias("dst_ip"),
            F.lit("TCP").alias("protocol"), F.lit(40000).alias("src_port"), F.lit(443).alias("dst_port"), F.lit("S").alias("tcp_flags"),
            F.lit(None).cast("string").alias("dns_query"), "payload_size", F.lit(60).cast("long").alias("packet_size"),
        )
        wire.write.parquet(f"{root}/host{host}/net")
        _named(spark, f"{root}/host{host}/net", "packets")
    cut = gzip.compress(b"2024-01-05T06:07:08Z host app: cut off\n" * 5000)[:-40]
    for name, data in (("auth-0.log.gz", cut), ("more.csv.gz", b"no archive"), ("security-0.xml.gz", cut), ("packets-0.parquet", b"no table"), ("notes.docx", b"x")):
        _put(spark, f"{root}/broken/{name}", data)
    return root


_EXPECTED = """expected AS (
        SELECT *, date_trunc('second', timestamp) AS sec, CASE event_type WHEN 'error' THEN event_id WHEN 'signup' THEN event_id
            WHEN 'purchase' THEN 'SUDO_COMMAND' WHEN 'view' THEN event_id ELSE 'NET_SYN_TCP' END AS id,
        CASE event_type WHEN 'purchase' THEN 'authentication' ELSE category END AS class FROM logs)"""


@query(
    f"""WITH {LOGS}, {_EXPECTED}
    SELECT 'event' AS what, id || ' ' || class AS name, count(*) AS n, CAST(sum(epoch_us(sec) // 1000000) AS BIGINT) AS seconds FROM expected GROUP BY ALL
    UNION ALL SELECT 'host', 'host' || (user_id % 2) || '/' || CASE WHEN event_type IN ('error', 'signup') THEN 'csv'
        WHEN event_type = 'purchase' THEN 'syslog' WHEN event_type = 'view' THEN 'windows' ELSE 'net' END, count(*), 0 FROM logs GROUP BY ALL
    UNION ALL SELECT 'rejected', unnest(['auth-0.log.gz', 'more.csv.gz', 'notes.docx', 'packets-0.parquet', 'security-0.xml.gz']), 1, 0"""
)
def read_logs_mixed(spark, sf_dir):
    """Every readable file of the folder, one reject row for each other; files of one name stay apart."""
    found = read_logs(spark, mixed_folder(spark, sf_dir), YEAR, ingest_ts())
    events = found.union().groupBy(F.concat_ws(" ", "event_id", "category").alias("name")).agg(
        F.count("*").alias("n"), F.sum(F.unix_seconds("timestamp")).alias("seconds")
    )
    files = found.file_counts().groupBy(F.regexp_extract("path", r"(host\d/\w+)/", 1).alias("name")).agg(F.sum("records").alias("n"))
    rejected = found.rejected.filter("reason <> ''").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(1).cast("long").alias("n"))
    none = F.lit(0).cast("long").alias("seconds")
    return (
        events.select(F.lit("event").alias("what"), "name", "n", "seconds")
        .unionByName(files.select(F.lit("host").alias("what"), "name", "n", none))
        .unionByName(rejected.select(F.lit("rejected").alias("what"), "name", "n", none))
    )


@query(
    f"""WITH {LOGS}, {_EXPECTED}
    SELECT CAST(sec AS DATE) AS date, id AS event_id, count(*) AS n, CAST(sum(epoch_us(sec) // 1000000) AS BIGINT) AS seconds, 1 AS runs, TRUE AS dense
    FROM expected GROUP BY ALL"""
)
def written_results(spark, sf_dir):
    """A whole run over the folder: read, analyse, write, read back; a run that broke off beside it stays unseen."""
    found = read_logs(spark, mixed_folder(spark, sf_dir), YEAR, ingest_ts())
    result = analyze(*found.frames, config={"brute_force_window": 86_400, "brute_force_threshold": 3}, staged=True)
    path = scratch(spark, "results")
    write_results(result.events, result.alerts, result.members, result.summary, path)
    broken = read_results(spark, path).events.limit(3)  # what a run that broke off has left
    broken.write.partitionBy("date").parquet(f"{path}/run=0-broken/events")
    back = read_results(spark, path)
    runs = back.runs.count()
    whole = back.events.agg((F.max("event_idx") == F.count("*") - 1).alias("dense"))
    counted = back.events.groupBy("date", "event_id").agg(F.count("*").alias("n"), F.sum(F.unix_seconds("timestamp")).alias("seconds"))
    return counted.join(F.broadcast(whole)).withColumn("runs", F.lit(runs))
