"""Registry, and log-shaped rows derived from the ``events`` table.

The benchmark tables are no logs. ``logs`` turns every event into a log event: the
event type decides the event id, category and message, the user the address. The
same derivation is written twice, as DataFrame code and as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL if there is one."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with ``ts`` as an instant in UTC."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_LOG_COLUMNS = """
    e.event_id AS event_idx,
    e.ts AS timestamp,
    e.user_id,
    e.event_type,
    CASE e.event_type
        WHEN 'error' THEN '4625'
        WHEN 'signup' THEN '4624'
        WHEN 'purchase' THEN CASE WHEN e.event_id % 10 = 0 THEN '4720' ELSE '4672' END
        WHEN 'view' THEN CASE WHEN e.event_id % 2 = 0 THEN '4660' ELSE '4663' END
        ELSE 'NET_TCP' END AS event_id,
    CASE e.event_type WHEN 'view' THEN 'file_access' WHEN 'click' THEN 'network' ELSE 'authentication' END AS category,
    CASE e.event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'info' END AS severity,
    CASE e.event_type
        WHEN 'error' THEN 'Failed password for invalid user u' || e.user_id || ' from ' || e.ip || ' port '
            || (1024 + e.event_id % 50000) || ' ssh2'
        WHEN 'signup' THEN 'Accepted publickey for u' || e.user_id || ' from ' || e.ip || ' port '
            || (1024 + e.event_id % 50000) || ' ssh2'
        WHEN 'purchase' THEN 'Special privileges assigned to u' || e.user_id
        WHEN 'view' THEN CASE WHEN e.event_id % 2 = 0 THEN 'Object deleted: /data/' ELSE 'Object read: /data/' END
            || e.event_id
        ELSE 'TCP from ' || e.ip || ' to ' || e.dst END AS message,
    e.ip AS source_ip,
    CASE WHEN e.event_type = 'click' THEN e.dst ELSE '' END AS dest_ip,
    '' AS dst_ip_raw,
    'u' || e.user_id AS username,
    'host' || (e.user_id % 10) AS hostname,
    '' AS process,
    CASE WHEN e.event_id % 50 = 0 THEN 'svc' || CAST(floor(e.event_id / 150) AS BIGINT)
         ELSE 'app' || (e.user_id % 5) END AS app,
    CASE WHEN e.event_type = 'click' AND e.event_id % 25 = 0 THEN
        CASE CAST(floor(e.event_id / 25) AS BIGINT) % 5 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'xss'
            WHEN 2 THEN 'path_traversal' WHEN 3 THEN 'command_injection' ELSE 'novel_probe' END
        ELSE 'benign' END AS threat_type,
    CAST(floor(e.value * 100) AS BIGINT) AS payload_size,
    CASE WHEN e.event_type <> 'click' THEN '' WHEN e.event_id % 2 = 0 THEN 'DNS' ELSE 'HTTPS' END AS service,
    CASE WHEN e.event_type = 'click' AND e.event_id % 2 = 0
        THEN 'h' || (e.event_id % 40) || '.example.org' ELSE '' END AS dns_query,
    'events' AS source,
    'web-' || (e.user_id % 3) || '.log' AS source_file,
    0 AS file_seq,
    e.event_id AS row_no"""

_ADDRESSED = """
    SELECT *, '10.0.' || CAST(floor(user_id / 250) AS BIGINT) || '.' || (user_id % 250) AS ip,
        '203.0.113.' || (event_id % 7) AS dst
    FROM {events}"""

LOGS = f"logs AS (SELECT {_LOG_COLUMNS} FROM ({_ADDRESSED.format(events='events')}) e)"


def logs(spark: SparkSession, sf_dir: str, process: str = "") -> DataFrame:
    """Log events; ``event_id`` of the table is dense and in time order, so it serves as ``event_idx``.

    ``process`` names the column to use as the process (``app``), none by default.
    """
    rows = events(spark, sf_dir)
    out = spark.sql(
        f"SELECT {_LOG_COLUMNS} FROM ({_ADDRESSED.format(events='{events}')}) e",
        events=rows,
    )
    return out.withColumn("process", F.col(process)) if process else out
