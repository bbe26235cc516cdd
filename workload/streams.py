"""Streaming and text-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtrail.functions.messages import APPLICATION_NAMES
from logtrail.operators.brute_force import failed_auth
from logtrail.operators.normalize import normalize_csv
from logtrail.plans.classify import TextModels, predict, train
from logtrail.session import stage
from logtrail.sources.csv import clean_header
from logtrail.streaming.bursts import burst_stream
from logtrail.streaming.ingest import ingest, ingested
from workload.base import LOGS, logs, query
from workload.detection import AUTH_W, BURST_T, FAILED, burst_ctes
from workload.parsing import NORMAL_SQL, PARSED_SQL, YEAR, app_sql, port_sql, ingest_ts, scratch, syslog_lines


@query(
    f"""WITH {LOGS}, {PARSED_SQL}, {NORMAL_SQL}
    SELECT event_id, category, severity, username, count(*) AS n, CAST(sum(ts_us // 1000000) AS BIGINT) AS seconds
    FROM syslog_events GROUP BY ALL"""
)
def stream_ingest(spark, sf_dir):
    """Lines land as text files, a stream parses and normalises them into the event table."""
    path = scratch(spark, "landing")
    syslog_lines(spark, sf_dir).select("value").write.text(f"{path}/in")
    ingest(spark, f"{path}/in", f"{path}/events", f"{path}/checkpoint", YEAR, ingest_ts=ingest_ts()).awaitTermination()
    return (
        ingested(spark, f"{path}/events")
        .groupBy("event_id", "category", "severity", "username")
        .agg(F.count("*").alias("n"), F.sum(F.unix_seconds("timestamp")).alias("seconds"))
    )


_DELIVERIES = 3


@query(
    f"""WITH {LOGS} SELECT event_id, category, severity, username, source_ip,
        message || CASE WHEN event_idx % 3 = 0 THEN ', then' || chr(10) || 'a second "line"' ELSE '' END AS message, count(*) AS n
    FROM logs GROUP BY ALL"""
)
def stream_ingest_csv(spark, sf_dir):
    """Delimited files with cells over lines arrive in several batches, and all of the first ones a second time elsewhere."""
    path = scratch(spark, "landing")
    text = F.when(F.col("event_idx") % 3 == 0, F.concat("message", F.lit(', then\na second "line"'))).otherwise(F.col("message"))
    columns = ["Event ID", "Category", "Severity", "Source IP", "Username", "Message"]
    rows = logs(spark, sf_dir).select(*[F.col(clean_header(c)).alias(c) for c in columns[:-1]], text.alias("Message"), "event_idx")
    header = {"header": True, "escape": '"'}
    for k in range(_DELIVERIES):
        part = rows.filter(F.col("event_idx") % _DELIVERIES == k).drop("event_idx")
        part.repartition(2).write.options(**header).csv(f"{path}/in/{k}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    fs = hadoop.Path(path).getFileSystem(conf)
    hadoop.FileUtil.copy(fs, hadoop.Path(f"{path}/in/0"), fs, hadoop.Path(f"{path}/in/again"), False, conf)
    how = {"csv_header": columns, "ingest_ts": ingest_ts(), "same_file": "name_and_size", "recursiveFileLookup": True, "maxFilesPerTrigger": 3}
    for _ in range(2):  # started again when all is done, it takes nothing
        ingest(spark, f"{path}/in", f"{path}/events", f"{path}/checkpoint", **how).awaitTermination()
    keys = ["event_id", "category", "severity", "username", "source_ip", "message"]
    return ingested(spark, f"{path}/events").groupBy(*keys).agg(F.count("*").alias("n"))


# A third of all rows has one key; rows arrive up to six hours after their time.
_KEY = "CASE WHEN event_idx % 3 = 0 THEN 'hot' ELSE source_ip END"
_DELAY = "event_idx * 7919 % 21600"
_SLICES = 6


@query(
    f"""WITH RECURSIVE {LOGS}, {burst_ctes(FAILED, _KEY, AUTH_W, BURST_T)}
    SELECT key, start AS start_us, max(t) AS last_us, count(*) AS n, min(first_idx) AS first_idx FROM m GROUP BY key, start"""
)
def stream_bursts(spark, sf_dir):
    """Failed logins replayed as a stream of many files, late rows among them; the windows equal those of the batch operator."""
    path = scratch(spark, "bursts")
    rows = failed_auth(logs(spark, sf_dir), "ip").select(F.expr(_KEY).alias("key"), "timestamp", "event_idx")
    rows = stage(rows, "failed")
    arrival = F.unix_seconds("timestamp") + F.expr(_DELAY)
    first, last = rows.agg(F.min(arrival), F.max(arrival)).first()
    for k in range(_SLICES):
        low, high = (first + (last + 1 - first) * n // _SLICES for n in (k, k + 1))
        rows.filter((arrival >= low) & (arrival < high)).repartition(4).write.mode("append").parquet(f"{path}/in")
    # A last row long after all others moves the watermark past every window.
    end = rows.agg((F.max("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("timestamp"))
    end.select(F.lit("end").alias("key"), "timestamp", F.lit(-1).cast("bigint").alias("event_idx")).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("key string, timestamp timestamp, event_idx long").option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    found = burst_stream(stream, AUTH_W, BURST_T, lateness="6 days", slot="1 minute")
    (
        found.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{path}/out")
        .awaitTermination()
    )
    return spark.read.schema("key string, start_us long, last_us long, n long, first_idx long").parquet(f"{path}/out")


@query(
    f"""WITH {LOGS} SELECT event_type, CASE event_type WHEN 'error' THEN 'linux_auth' WHEN 'signup' THEN 'linux_auth'
        WHEN 'purchase' THEN 'windows_security' WHEN 'view' THEN 'application' ELSE 'nginx_access' END AS label,
        count(*) AS n FROM logs GROUP BY ALL"""
)
def text_labels(spark, sf_dir):
    """A model fitted on at most 2,000 labelled messages labels all messages."""
    rows = logs(spark, sf_dir).select("event_type", F.col("message").alias("text"), "timestamp")
    label = (
        F.when(F.col("event_type").isin("error", "signup"), "linux_auth")
        .when(F.col("event_type") == "purchase", "windows_security")
        .when(F.col("event_type") == "view", "application")
        .otherwise("nginx_access")
    )
    model = train(rows.select("text", label.alias("label")), most_rows=2000)
    return (
        predict(rows, model, "text", "label").groupBy("event_type", "label").agg(F.count("*").alias("n"))
    )


_ATTACKS = """CASE threat_type
    WHEN 'sql_injection' THEN 'GET /items?id=' || event_idx || ' UNION SELECT password FROM users WHERE name = admin'
    WHEN 'xss' THEN 'GET /find?q=<script>alert(document.cookie)</script> ref ' || event_idx
    WHEN 'path_traversal' THEN 'GET /files/../../../../etc/passwd page ' || event_idx
    WHEN 'command_injection' THEN 'GET /ping?host=localhost; wget evil sh; cat shadow ' || event_idx
    WHEN 'novel_probe' THEN 'OPTIONS unusual scanner verb sweep ' || event_idx ELSE message END"""
_SOURCES = """CASE WHEN threat_type <> 'benign' THEN 'nginx_access' WHEN event_type IN ('error', 'signup') THEN 'linux_auth'
    WHEN event_type = 'purchase' THEN 'windows_security' WHEN event_type = 'view' THEN 'application' ELSE 'nginx_access' END"""
_APPS = " ".join(f"WHEN '{source}' THEN '{name}'" for source, name in APPLICATION_NAMES.items())


@query(
    f"""WITH {LOGS}, m AS (SELECT *, {_ATTACKS} AS text FROM logs)
    SELECT event_idx AS row_no, {_SOURCES} AS source, threat_type,
        CASE WHEN threat_type IN ('sql_injection', 'command_injection') THEN 'critical' WHEN threat_type <> 'benign' THEN 'high' ELSE severity END AS severity,
        'App: ' || CASE {app_sql("text")} WHEN 'Unknown Application' THEN CASE {_SOURCES} {_APPS} END ELSE {app_sql("text")} END || CASE WHEN {port_sql("text")} <> '' THEN ' | Port: ' || {port_sql("text")} ELSE '' END
            || CASE WHEN threat_type <> 'benign' THEN ' | AI THREAT: ' || upper(threat_type) ELSE '' END AS details
    FROM m"""
)
def modelled_events(spark, sf_dir):
    """Both text models, fitted on at most 2,000 labelled messages each, in the normaliser: source, threat, severity and details."""
    rows = logs(spark, sf_dir).withColumns({"text": F.expr(_ATTACKS), "label": F.expr(_SOURCES)})
    models = TextModels(
        train(rows.select("text", "label"), most_rows=2000),
        train(rows.select("text", F.col("threat_type").alias("label")), most_rows=2000),
    )
    records = rows.select(
        F.col("text").alias("message"), "severity", "source_file", F.lit(0).alias("file_seq"), F.col("event_idx").alias("row_no")
    )
    return normalize_csv(records, ingest_ts(), models).select("row_no", "source", "threat_type", "severity", "details")
