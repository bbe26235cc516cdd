"""Timeline and detector queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrail.functions.network import is_private_ip
from logtrail.functions.times import seconds_between
from logtrail.operators.annotate import annotate, event_alerts
from logtrail.operators.brute_force import detect_brute_force, failed_auth, followed_by_success
from logtrail.operators.exfiltration import detect_exfiltration, flow_services, flows, suspicious_flows
from logtrail.operators.file_access import detect_file_access
from logtrail.operators.new_source import detect_new_source, source_profiles
from logtrail.operators.ordering import build_timeline, first_following, union_sources
from logtrail.operators.privilege import account_burst, detect_privilege_escalation, escalations
from logtrail.operators.threat import detect_threats
from logtrail.operators.windows import greedy_windows, window_members
from logtrail.plans.correlate import DetectionConfig, correlate, staged_together, together
from logtrail.schema import FAILED_AUTH_IDS, SUCCESS_AUTH_IDS
from workload.base import LOGS, logs, query

DAY = 86_400
BURST_T = 3
AUTH_W, FILE_W = 3 * DAY, 5 * DAY
CONFIG = DetectionConfig(
    brute_force_window=AUTH_W,
    brute_force_threshold=BURST_T,
    brute_force_entity="ip",
    escalation_window=DAY,
    escalation_lookahead=None,
    file_access_window=FILE_W,
    file_access_threshold=BURST_T,
    exfil_bytes_threshold=30_000,
    exfil_packet_threshold=2,
    exfil_window=7 * DAY,
)

FAILED = (
    f"(event_id IN {FAILED_AUTH_IDS}"
    " OR (category = 'authentication' AND regexp_matches(lower(message), 'failed|failure|denied|invalid')))"
)
FILES = (
    "(category = 'file_access' OR event_id IN ('4663', '4656', '4660', '4670')"
    " OR regexp_matches(lower(message), 'file|object access|delete|modify'))"
)
SUCCESS = f"event_id IN {SUCCESS_AUTH_IDS}"


def iso(column: str) -> str:
    return (
        f"CASE WHEN epoch_us({column}) % 1000000 = 0 THEN strftime({column}, '%Y-%m-%dT%H:%M:%S+00:00')"
        f" ELSE strftime({column}, '%Y-%m-%dT%H:%M:%S.%f+00:00') END"
    )


def burst_ctes(
    where: str, key: str, seconds: int, threshold: int, p: str = "", source: str = "logs", t: str = "epoch_us(timestamp)"
) -> str:
    """CTEs for greedy windows: a recursive walk over the ranked rows of each key."""
    return f"""
    {p}f AS (
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, event_idx) - 1 AS rn
        FROM (SELECT *, {key} AS key, {t} AS t FROM {source} WHERE {where})),
    {p}c AS (
        SELECT key, t, event_idx, rn, count(*) OVER (
            PARTITION BY key ORDER BY t RANGE BETWEEN CURRENT ROW AND {seconds * 1_000_000} FOLLOWING) AS n FROM {p}f),
    {p}s AS (
        SELECT key, CAST(0 AS BIGINT) AS rn FROM {p}c WHERE rn = 0
        UNION ALL
        SELECT s.key, s.rn + CASE WHEN c.n >= {threshold} THEN c.n ELSE 1 END
        FROM {p}s s JOIN {p}c c ON c.key = s.key AND c.rn = s.rn),
    {p}w AS (
        SELECT c.key, c.rn, c.n, c.t AS start, c.event_idx AS first_idx
        FROM {p}s s JOIN {p}c c ON c.key = s.key AND c.rn = s.rn WHERE c.n >= {threshold}),
    {p}m AS (
        SELECT w.start, w.n, w.first_idx, f.* FROM {p}w w JOIN {p}f f ON f.key = w.key AND f.rn >= w.rn AND f.rn < w.rn + w.n)"""


AUTH_BURST = burst_ctes(FAILED, "source_ip", AUTH_W, BURST_T)
FILE_BURST = burst_ctes(FILES, "source_ip", FILE_W, BURST_T)


def alert_columns(alerts: DataFrame) -> DataFrame:
    """Alerts with plain column types, for comparison."""
    return alerts.select(
        "alert_id",
        "rule_name",
        "severity",
        "title",
        "description",
        F.array_join("evidence", " || ").alias("evidence"),
        F.unix_micros("timestamp").alias("start_us"),
        F.unix_micros("end_timestamp").alias("end_us"),
        "source_ip",
        "target",
        "process",
        "event_count",
        F.round("confidence", 4).alias("confidence"),
        "mitre_tactic",
        "mitre_technique",
    )


# --- timeline --------------------------------------------------------------------------------


@query(f"WITH {LOGS} SELECT event_type, source_file, count(*) AS n FROM logs GROUP BY ALL")
def union_of_sources(spark, sf_dir):
    parts = [logs(spark, sf_dir).filter(F.col("event_type") == t) for t in ("click", "error", "purchase", "signup", "view")]
    merged = union_sources(*[p.drop("dns_query") if i else p for i, p in enumerate(parts)])
    return merged.groupBy("event_type", "source_file").agg(F.count("*").alias("n"))


_SHIFTED = """shifted AS (
    SELECT event_idx AS row_no, 0 AS file_seq, source_file, event_type,
        CASE WHEN event_idx % 11 = 0 THEN NULL ELSE date_trunc('hour', timestamp) END AS timestamp FROM logs)"""


def _shifted(spark, sf_dir):
    """Hour-grained times, some missing, so that ties and NULLs decide the order."""
    return logs(spark, sf_dir).select(
        F.col("event_idx").alias("row_no"),
        "file_seq",
        "source_file",
        "event_type",
        F.when(F.col("event_idx") % 11 != 0, F.date_trunc("hour", "timestamp")).alias("timestamp"),
    )


@query(
    f"""WITH {LOGS}, {_SHIFTED}
    SELECT row_no, CAST(row_number() OVER (ORDER BY timestamp NULLS FIRST, file_seq, source_file, row_no) - 1 AS BIGINT)
        AS event_idx FROM shifted"""
)
def timeline_index(spark, sf_dir):
    shifted = _shifted(spark, sf_dir)
    return build_timeline(
        shifted.filter("event_type = 'click'"), shifted.filter("event_type <> 'click'")
    ).select("row_no", "event_idx")


@query(
    f"""WITH {LOGS}, gaps AS (
        SELECT source_ip, abs(epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY source_ip ORDER BY event_idx)))
            / 1000000.0 AS s FROM logs)
    SELECT source_ip, CAST(round(max(s), 3) AS DOUBLE) AS widest, CAST(round(min(s), 3) AS DOUBLE) AS narrowest
    FROM gaps GROUP BY source_ip"""
)
def time_gaps(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("source_ip").orderBy("event_idx")
    gap = seconds_between(F.lag("timestamp").over(order), F.col("timestamp"))
    return (
        logs(spark, sf_dir)
        .select("source_ip", gap.alias("s"))
        .groupBy("source_ip")
        .agg(F.round(F.max("s"), 3).alias("widest"), F.round(F.min("s"), 3).alias("narrowest"))
    )


# --- brute force -----------------------------------------------------------------------------


@query(f"WITH {LOGS} SELECT username, count(*) AS n, min(event_idx) AS first_idx FROM logs WHERE {FAILED} GROUP BY username")
def failed_logins(spark, sf_dir):
    failed = failed_auth(logs(spark, sf_dir), "user")
    return failed.groupBy(F.col("key").alias("username")).agg(
        F.count("*").alias("n"), F.min("event_idx").alias("first_idx")
    )


@query(f"WITH RECURSIVE {LOGS}, {AUTH_BURST} SELECT key, start, CAST(n AS BIGINT) AS n, first_idx FROM w")
def brute_force_windows(spark, sf_dir):
    rows = failed_auth(logs(spark, sf_dir), "ip").select("key", "t", "event_idx")
    members = window_members(rows, greedy_windows(rows, AUTH_W, BURST_T), AUTH_W)
    return members.groupBy("key", "start").agg(F.count("*").alias("n"), F.min("event_idx").alias("first_idx"))


_COMPROMISED = f"""ends AS (SELECT key, start, max(t) AS last_t FROM m GROUP BY key, start),
    hit AS (
        SELECT DISTINCT e.key, e.start FROM ends e JOIN logs l
        ON l.source_ip = e.key AND {SUCCESS.replace("event_id", "l.event_id")}
            AND abs(epoch_us(l.timestamp) - e.last_t) <= {{seconds}} * CAST(1000000 AS BIGINT))"""


@query(f"WITH RECURSIVE {LOGS}, {AUTH_BURST}, {_COMPROMISED.format(seconds=21_600)} SELECT key, start FROM hit")
def brute_force_success(spark, sf_dir):
    log_rows = logs(spark, sf_dir)
    rows = failed_auth(log_rows, "ip").select("key", "t", "event_idx")
    members = window_members(rows, greedy_windows(rows, AUTH_W, BURST_T), AUTH_W)
    ends = members.groupBy("key", "start").agg(F.max("t").alias("last_t"))
    return followed_by_success(ends, log_rows, seconds=21_600)


_BRUTE_FORCE_ALERTS = f"""
    SELECT CAST(a.first_idx AS BIGINT) AS alert_id, 'brute_force' AS rule_name,
        CASE WHEN h.key IS NULL THEN 'high' ELSE 'critical' END AS severity,
        'Brute Force Attack Detected' AS title,
        'Detected ' || a.n || ' failed authentication attempts from ' || a.key || ' within {AUTH_W}s'
            || CASE WHEN h.key IS NULL THEN '' ELSE ' — FOLLOWED BY SUCCESSFUL LOGIN (possible compromise)' END
            || ' targeting user ''' || a.username || '''' AS description,
        a.evidence, a.start AS start_us, a.last_t AS end_us, a.key AS source_ip, a.username AS target, '' AS process,
        CAST(a.n AS BIGINT) AS event_count,
        round(least(CAST(0.5 AS DOUBLE) + (a.n - {BURST_T}) * CAST(0.1 AS DOUBLE), 1.0), 4) AS confidence,
        'Credential Access' AS mitre_tactic, 'T1110 - Brute Force' AS mitre_technique
    FROM (
        SELECT key, start, any_value(n) AS n, any_value(first_idx) AS first_idx, max(t) AS last_t,
            arg_min(username, event_idx) AS username,
            string_agg({iso("timestamp")} || ' - ' || event_id || ': ' || left(message, 80), ' || ' ORDER BY event_idx)
                FILTER (k <= 10) AS evidence
        FROM (SELECT *, row_number() OVER (PARTITION BY key, start ORDER BY event_idx) AS k FROM m) GROUP BY key, start) a
    LEFT JOIN hit h ON h.key = a.key AND h.start = a.start"""


@query(f"WITH RECURSIVE {LOGS}, {AUTH_BURST}, {_COMPROMISED.format(seconds=600)} {_BRUTE_FORCE_ALERTS}")
def brute_force_alerts(spark, sf_dir):
    return alert_columns(detect_brute_force(logs(spark, sf_dir), AUTH_W, BURST_T, "ip").alerts)


@query(f"WITH RECURSIVE {LOGS}, {AUTH_BURST} SELECT CAST(first_idx AS BIGINT) AS alert_id, event_idx FROM m")
def brute_force_members(spark, sf_dir):
    return detect_brute_force(logs(spark, sf_dir), AUTH_W, BURST_T, "ip").members


@query(
    f"""WITH RECURSIVE {LOGS}, {burst_ctes(FAILED, "app", 21_600, BURST_T)}
    SELECT key, start, CAST(n AS BIGINT) AS n FROM w"""
)
def brute_force_by_process(spark, sf_dir):
    """Few keys with very many rows each, as when a service name is the key."""
    rows = failed_auth(logs(spark, sf_dir, "app"), "process").select("key", "t", "event_idx")
    members = window_members(rows, greedy_windows(rows, 21_600, BURST_T), 21_600)
    return members.groupBy("key", "start").agg(F.count("*").alias("n"))


# --- rare sources ----------------------------------------------------------------------------

_PRIVILEGED = """(event_id IN ('4672', '4673', '4674', '4720', '4726', '4728', '4732', '4719', '4739', '1102',
    'SUDO_COMMAND', 'SSH_LOGIN_SUCCESS', '4624') OR severity IN ('high', 'critical')
    OR regexp_matches(lower(message), 'privilege|admin|root|sudo'))"""
_PROFILES = f"""profiles AS (
    SELECT app AS key, count(*) AS n, count(*) FILTER ({_PRIVILEGED}) AS privileged, min(event_idx) AS first_idx,
        arg_min(source_ip, event_idx) AS source_ip, arg_min(hostname, event_idx) AS hostname,
        arg_min(timestamp, event_idx) AS timestamp FROM logs GROUP BY app),
    rare AS (SELECT * FROM profiles WHERE n <= greatest(3.0, (SELECT avg(n) FROM profiles) * CAST(0.1 AS DOUBLE)))"""


@query(f"WITH {LOGS}, {_PROFILES} SELECT key, n, privileged, first_idx FROM rare")
def rare_sources(spark, sf_dir):
    profiles = source_profiles(logs(spark, sf_dir, "app"))
    return profiles.filter("rare").select("key", "n", "privileged", "first_idx")


_PROFILE_LINES = f"""{_PROFILES}, lines AS (
        SELECT app AS key, string_agg({iso("timestamp")} || ' - ' || event_id || ': ' || left(message, 80), ' || '
            ORDER BY event_idx) FILTER (k <= 10) AS evidence
        FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY event_idx) AS k FROM logs WHERE {_PRIVILEGED})
        GROUP BY app)"""
_NEW_SOURCE_ALERTS = """
    SELECT (CAST(1 AS BIGINT) << 56) | first_idx AS alert_id, 'new_ip' AS rule_name, 'high' AS severity,
        'Suspicious New IP: ' || r.key AS title,
        'IP ' || r.key || ' appeared only ' || n || ' time(s) but performed ' || privileged || ' privileged action(s). '
            || 'This may indicate unauthorized access from an unknown source.' AS description,
        evidence, epoch_us(timestamp) AS start_us, CAST(NULL AS BIGINT) AS end_us, source_ip, hostname AS target,
        r.key AS process, privileged AS event_count,
        round(least(CAST(0.6 AS DOUBLE) + privileged * CAST(0.15 AS DOUBLE), 0.95), 4) AS confidence,
        'Initial Access' AS mitre_tactic, 'T1078 - Valid Accounts' AS mitre_technique
    FROM rare r JOIN lines l ON l.key = r.key WHERE privileged > 0"""


@query(f"WITH {LOGS}, {_PROFILE_LINES} {_NEW_SOURCE_ALERTS}")
def new_source_alerts(spark, sf_dir):
    return alert_columns(detect_new_source(logs(spark, sf_dir, "app")).alerts)


@query(
    f"""WITH {LOGS}, {_PROFILES}
    SELECT (CAST(1 AS BIGINT) << 56) | r.first_idx AS alert_id, l.event_idx
    FROM rare r JOIN logs l ON l.app = r.key WHERE {_PRIVILEGED.replace("severity", "l.severity")}"""
)
def new_source_members(spark, sf_dir):
    return detect_new_source(logs(spark, sf_dir, "app")).members


# --- privilege escalation --------------------------------------------------------------------

_ESCALATIONS = f"""esc AS (
    SELECT f.event_idx, f.source_ip, f.timestamp, f.username, f.message,
        (SELECT min(s.event_idx) FROM logs s WHERE s.source_ip = f.source_ip AND s.event_idx > f.event_idx
            AND s.{SUCCESS} {{look_s}} AND epoch_us(s.timestamp) - epoch_us(f.timestamp) <= {DAY} * CAST(1000000 AS BIGINT)) AS success_idx,
        (SELECT min(p.event_idx) FROM logs p WHERE p.source_ip = f.source_ip AND p.event_idx > f.event_idx
            AND p.event_id IN ('4672', '4673', 'SUDO_COMMAND') {{look_p}}
            AND epoch_us(p.timestamp) - epoch_us(f.timestamp) <= {DAY} * CAST(1000000 AS BIGINT)) AS privilege_idx
    FROM logs f WHERE f.event_id IN ('4625'))"""
_ALL_ESCALATIONS = _ESCALATIONS.format(look_s="", look_p="")
_NEAR_ESCALATIONS = _ESCALATIONS.format(
    look_s="AND s.event_idx - f.event_idx <= 199", look_p="AND p.event_idx - f.event_idx <= 199"
)


@query(
    f"""WITH {LOGS}, {_ALL_ESCALATIONS} SELECT event_idx, success_idx, privilege_idx FROM esc
    WHERE success_idx IS NOT NULL AND privilege_idx IS NOT NULL"""
)
def privilege_escalation(spark, sf_dir):
    found = escalations(logs(spark, sf_dir), DAY, None)
    return found.select(
        "event_idx",
        F.col("success.event_idx").alias("success_idx"),
        F.col("privilege.event_idx").alias("privilege_idx"),
    )


@query(
    f"""WITH {LOGS}, {_NEAR_ESCALATIONS} SELECT event_idx, success_idx, privilege_idx FROM esc
    WHERE success_idx IS NOT NULL AND privilege_idx IS NOT NULL"""
)
def privilege_escalation_near(spark, sf_dir):
    """With the bound of 199 timeline rows."""
    found = escalations(logs(spark, sf_dir), DAY)
    return found.select(
        "event_idx",
        F.col("success.event_idx").alias("success_idx"),
        F.col("privilege.event_idx").alias("privilege_idx"),
    )


@query(
    f"""WITH {LOGS}
    SELECT f.event_idx, (
        SELECT min(v.event_idx) FROM logs v WHERE v.source_ip = f.source_ip AND v.event_idx > f.event_idx
            AND v.event_id = '4660') AS next_deletion
    FROM logs f"""
)
def next_deletion(spark, sf_dir):
    """The forward search by itself: the next deletion of the same address, for every event."""
    rows = logs(spark, sf_dir).select("event_idx", "source_ip", "event_id")
    found = first_following(
        rows, "source_ip", {"next": (F.col("event_id") == "4660", F.struct("event_idx"))}, segment_rows=20_000
    )
    return found.select("event_idx", F.col("next.event_idx").alias("next_deletion"))


_BURST = """managed AS (
        SELECT *, row_number() OVER (ORDER BY event_idx) - 1 AS rn, count(*) OVER () AS total
        FROM logs WHERE event_id IN ('4720', '4722', '4724', '4726', '4728', '4732')),
    runs AS (
        SELECT a.rn AS first_rn, b.rn AS last_rn, epoch_us(b.timestamp) - epoch_us(a.timestamp) AS span
        FROM managed a JOIN managed b ON b.rn = least(a.rn + 4, a.total - 1) WHERE a.rn <= a.total - 3),
    first_run AS (SELECT * FROM runs WHERE span <= {seconds} * CAST(1000000 AS BIGINT) ORDER BY first_rn LIMIT 1)"""


@query(
    f"""WITH {LOGS}, {_BURST.format(seconds=DAY)}
    SELECT m.event_idx, CAST(m.rn AS BIGINT) AS rn, CAST(round(r.span / 1000000.0, 3) AS DOUBLE) AS span
    FROM managed m JOIN first_run r ON m.rn BETWEEN r.first_rn AND r.last_rn"""
)
def account_burst_rows(spark, sf_dir):
    return account_burst(logs(spark, sf_dir), seconds=DAY).select("event_idx", "rn", F.round("span", 3).alias("span"))


_ACCOUNT_BURST = _BURST.format(seconds=DAY)
_PRIVILEGE_ALERTS = f"""
    SELECT (CAST(2 AS BIGINT) << 56) | e.event_idx AS alert_id, 'privilege_escalation' AS rule_name, 'critical' AS severity,
        'Privilege Escalation Detected' AS title,
        'Source ' || e.source_ip || ': Failed authentication at ' || {iso("e.timestamp")} || ', followed by successful logon '
            || 'and privilege elevation within {DAY}s.' AS description,
        'FAIL: ' || {iso("e.timestamp")} || ' - 4625: ' || left(e.message, 60) || ' || SUCCESS: ' || {iso("s.timestamp")}
            || ' - ' || s.event_id || ' || PRIVILEGE: ' || {iso("p.timestamp")} || ' - ' || p.event_id AS evidence,
        epoch_us(e.timestamp) AS start_us, epoch_us(p.timestamp) AS end_us, e.source_ip, e.username AS target, '' AS process,
        CAST(3 AS BIGINT) AS event_count, CAST(0.85 AS DOUBLE) AS confidence, 'Privilege Escalation' AS mitre_tactic,
        'T1068 - Exploitation for Privilege Escalation' AS mitre_technique
    FROM esc e JOIN logs s ON s.event_idx = e.success_idx JOIN logs p ON p.event_idx = e.privilege_idx
    UNION ALL
    SELECT (CAST(2 AS BIGINT) << 56) | min(m.event_idx), 'privilege_escalation', 'high', 'Rapid Account Manipulation',
        'Detected ' || count(*) || ' account management operations within ' || CAST(round_even(any_value(r.span) / 1000000.0, 0) AS BIGINT) || 's.',
        string_agg({iso("timestamp")} || ' - ' || event_id || ': ' || left(message, 60), ' || ' ORDER BY event_idx),
        min(epoch_us(timestamp)), max(epoch_us(timestamp)), '', '', '', count(*), CAST(0.75 AS DOUBLE), 'Persistence', 'T1136 - Create Account'
    FROM managed m JOIN first_run r ON m.rn BETWEEN r.first_rn AND r.last_rn HAVING count(*) > 0"""


@query(f"WITH {LOGS}, {_ALL_ESCALATIONS}, {_ACCOUNT_BURST} {_PRIVILEGE_ALERTS}")
def privilege_alerts(spark, sf_dir):
    """Both patterns: failure, success and elevation of one source, and the burst of account management."""
    return alert_columns(detect_privilege_escalation(logs(spark, sf_dir), DAY, None, burst_seconds=DAY).alerts)


@query(
    f"""WITH {LOGS}, {_ALL_ESCALATIONS}, {_ACCOUNT_BURST}
    SELECT (CAST(2 AS BIGINT) << 56) | event_idx AS alert_id, unnest([event_idx, success_idx, privilege_idx]) AS event_idx
    FROM esc WHERE success_idx IS NOT NULL AND privilege_idx IS NOT NULL
    UNION ALL SELECT (CAST(2 AS BIGINT) << 56) | min(m.event_idx) OVER (), m.event_idx
    FROM managed m JOIN first_run r ON m.rn BETWEEN r.first_rn AND r.last_rn"""
)
def privilege_members(spark, sf_dir):
    return detect_privilege_escalation(logs(spark, sf_dir), DAY, None, burst_seconds=DAY).members


# --- file access -----------------------------------------------------------------------------


_FILE_ALERTS = f"""
    SELECT (CAST(3 AS BIGINT) << 56) | any_value(first_idx) AS alert_id, 'file_access_anomaly' AS rule_name,
        CASE WHEN count(*) FILTER ({{d}}) > count(*) * 0.3 THEN 'critical' ELSE 'high' END AS severity,
        CASE WHEN count(*) FILTER ({{d}}) > count(*) * 0.3 THEN 'Possible Ransomware Activity'
            ELSE 'Bulk File Access Anomaly' END AS title,
        'Detected ' || count(*) || ' file operations by ''' || key || ''' within {FILE_W}s.' AS description,
        string_agg({iso("timestamp")} || ' - ' || event_id || ': ' || left(message, 80), ' || ' ORDER BY event_idx)
            FILTER (k <= 10) AS evidence,
        start AS start_us, max(t) AS end_us, key AS source_ip, key AS target, '' AS process, count(*) AS event_count,
        round(least(CAST(0.6 AS DOUBLE) + (count(*) - {BURST_T}) * CAST(0.05 AS DOUBLE), 0.95), 4) AS confidence,
        CASE WHEN count(*) FILTER ({{d}}) > count(*) * 0.3 THEN 'Impact' ELSE 'Collection' END AS mitre_tactic,
        CASE WHEN count(*) FILTER ({{d}}) > count(*) * 0.3 THEN 'T1486' ELSE 'T1005' END AS mitre_technique
    FROM (SELECT *, row_number() OVER (PARTITION BY key, start ORDER BY event_idx) AS k FROM m)
    GROUP BY key, start""".replace("{d}", "event_id = '4660' OR contains(lower(message), 'delete')")


@query(f"WITH RECURSIVE {LOGS}, {FILE_BURST} {_FILE_ALERTS}")
def file_access_alerts(spark, sf_dir):
    return alert_columns(detect_file_access(logs(spark, sf_dir), FILE_W, BURST_T).alerts)


@query(f"WITH RECURSIVE {LOGS}, {FILE_BURST} SELECT (CAST(3 AS BIGINT) << 56) | first_idx AS alert_id, event_idx FROM m")
def file_access_members(spark, sf_dir):
    return detect_file_access(logs(spark, sf_dir), FILE_W, BURST_T).members


# --- exfiltration ----------------------------------------------------------------------------

FLOWS = """flows AS (
    SELECT 'unknown' AS flow_process, source_ip AS src, dest_ip AS dst, CAST(sum(payload_size) AS BIGINT) AS bytes,
        count(*) AS packets, min(event_idx) AS first_idx, min(epoch_us(timestamp)) AS first_us,
        max(epoch_us(timestamp)) AS last_us, count(nullif(dns_query, '')) AS dns_queries,
        count(DISTINCT nullif(dns_query, '')) AS dns_names
    FROM logs WHERE category = 'network' AND dest_ip <> '' GROUP BY source_ip, dest_ip)"""
SUSPICIOUS = f"""suspicious AS (
    SELECT *, concat_ws('; ',
        CASE WHEN bytes >= {CONFIG.exfil_bytes_threshold} THEN 'Large data transfer: ' || format('{{:,}}', bytes) || ' bytes' END,
        CASE WHEN packets >= {CONFIG.exfil_packet_threshold} AND last_us - first_us <= {CONFIG.exfil_window} * CAST(1000000 AS BIGINT)
            THEN 'High packet volume: ' || packets || ' packets in '
                || CAST(round_even((last_us - first_us) / 1000000.0, 0) AS BIGINT) || 's' END,
        CASE WHEN dns_queries >= 20 AND dns_names >= 15
            THEN 'Possible DNS tunneling: ' || dns_names || ' unique DNS queries' END) AS reasons,
        CAST(bytes >= {CONFIG.exfil_bytes_threshold} AS INT) + CAST(packets >= {CONFIG.exfil_packet_threshold}
            AND last_us - first_us <= {CONFIG.exfil_window} * CAST(1000000 AS BIGINT) AS INT)
            + CAST(dns_queries >= 20 AND dns_names >= 15 AS INT) AS reason_count
    FROM flows)"""
_EXFIL = (CONFIG.exfil_bytes_threshold, CONFIG.exfil_packet_threshold, CONFIG.exfil_window)


@query(f"WITH {LOGS}, {FLOWS} SELECT * FROM flows")
def exfil_flows(spark, sf_dir):
    return flows(logs(spark, sf_dir)).select(
        "flow_process", "src", "dst", "bytes", "packets", "first_idx", F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"), "dns_queries", "dns_names",
    )


@query(f"WITH {LOGS}, {FLOWS}, {SUSPICIOUS} SELECT src, dst, reasons FROM suspicious WHERE reason_count > 0")
def exfil_reasons(spark, sf_dir):
    found = suspicious_flows(flows(logs(spark, sf_dir)), *_EXFIL)
    return found.select("src", "dst", F.array_join("reasons", "; ").alias("reasons"))


@query(
    f"""WITH {LOGS} SELECT 'unknown' AS flow_process, source_ip AS src, dest_ip AS dst, service, count(*) AS packets
    FROM logs WHERE category = 'network' AND dest_ip <> '' AND service <> '' GROUP BY ALL"""
)
def exfil_services(spark, sf_dir):
    return flow_services(logs(spark, sf_dir))


EXFIL_ALERTS = f"""
    SELECT (CAST(4 AS BIGINT) << 56) | s.first_idx AS alert_id, 'data_exfiltration' AS rule_name, 'critical' AS severity,
        'Potential Data Exfiltration to ' || dst AS title,
        'Suspicious outbound traffic from ' || src || ' → ' || dst || ': ' || reasons AS description, evidence,
        first_us AS start_us, last_us AS end_us, src AS source_ip, dst AS target, '' AS process, packets AS event_count,
        round(least(CAST(0.5 AS DOUBLE) + reason_count * CAST(0.2 AS DOUBLE), 0.95), 4) AS confidence,
        'Exfiltration' AS mitre_tactic, 'T1048 - Exfiltration Over Alternative Protocol' AS mitre_technique
    FROM suspicious s JOIN (
        SELECT source_ip, dest_ip, string_agg({iso("timestamp")} || ' - ' || left(message, 80), ' || ' ORDER BY event_idx)
            FILTER (k <= 10) AS evidence
        FROM (SELECT *, row_number() OVER (PARTITION BY source_ip, dest_ip ORDER BY event_idx) AS k FROM logs
            WHERE category = 'network') GROUP BY ALL) l ON l.source_ip = s.src AND l.dest_ip = s.dst
    WHERE reason_count > 0"""


@query(f"WITH {LOGS}, {FLOWS}, {SUSPICIOUS} {EXFIL_ALERTS}")
def exfil_alerts(spark, sf_dir):
    return alert_columns(detect_exfiltration(logs(spark, sf_dir), *_EXFIL).alerts)


@query(
    f"""WITH {LOGS}, {FLOWS}, {SUSPICIOUS}
    SELECT (CAST(4 AS BIGINT) << 56) | s.first_idx AS alert_id, l.event_idx
    FROM suspicious s JOIN logs l ON l.source_ip = s.src AND l.dest_ip = s.dst WHERE reason_count > 0"""
)
def exfil_members(spark, sf_dir):
    return detect_exfiltration(logs(spark, sf_dir), *_EXFIL).members


@query(
    r"""WITH ips AS (
        SELECT doc_id AS id, regexp_extract(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b') AS ip FROM documents
        UNION ALL SELECT event_id, CAST(event_id % 256 AS VARCHAR) || '.' || (user_id % 256) || '.1.2' FROM events
        UNION ALL SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'fe80::1' WHEN event_id % 3 = 1 THEN 'N/A' ELSE '10.x.1.1' END
            FROM events),
    parts AS (SELECT id, ip, try_cast(split_part(ip, '.', 1) AS INT) AS a, try_cast(split_part(ip, '.', 2) AS INT) AS b,
        length(ip) - length(replace(ip, '.', '')) AS dots FROM ips)
    SELECT id, ip, CASE WHEN dots <> 3 OR a IS NULL OR b IS NULL OR a IN (10, 127) OR (a = 172 AND b BETWEEN 16 AND 31)
        OR (a = 192 AND b = 168) OR ip = '0.0.0.0' THEN 'private' ELSE 'public' END AS kind FROM parts"""
)
def private_ip(spark, sf_dir):
    from logtrail.functions.messages import first_ipv4
    from workload.base import events, table

    made = events(spark, sf_dir)
    ips = (
        table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("id"), first_ipv4(F.col("text")).alias("ip"))
        .unionByName(made.selectExpr("event_id AS id", "(event_id % 256) || '.' || (user_id % 256) || '.1.2' AS ip"))
        .unionByName(
            made.selectExpr(
                "event_id AS id",
                "CASE WHEN event_id % 3 = 0 THEN 'fe80::1' WHEN event_id % 3 = 1 THEN 'N/A' ELSE '10.x.1.1' END AS ip",
            )
        )
    )
    return ips.withColumn("kind", F.when(is_private_ip("ip"), "private").otherwise("public"))


# --- threats ---------------------------------------------------------------------------------

THREAT_ALERTS = f"""
    SELECT (CAST(5 AS BIGINT) << 56) | event_idx AS alert_id, 'ai_anomaly' AS rule_name,
        CASE WHEN threat_type IN ('sql_injection', 'command_injection') THEN 'critical' ELSE 'high' END AS severity,
        'AI Detection: ' || CASE threat_type WHEN 'sql_injection' THEN 'Sql Injection' WHEN 'xss' THEN 'Xss'
            WHEN 'path_traversal' THEN 'Path Traversal' WHEN 'command_injection' THEN 'Command Injection'
            ELSE 'Novel Probe' END AS title,
        'Machine Learning model identified a highly suspicious ' || replace(threat_type, '_', ' ')
            || ' pattern in the log message from ' || app || '.' AS description,
        'RAW: ' || message AS evidence, epoch_us(timestamp) AS start_us, CAST(NULL AS BIGINT) AS end_us, source_ip,
        hostname AS target, app AS process, CAST(1 AS BIGINT) AS event_count, CAST(0.9 AS DOUBLE) AS confidence,
        CASE WHEN threat_type = 'novel_probe' THEN 'Suspicious Activity'
            WHEN threat_type = 'command_injection' THEN 'Execution' ELSE 'Initial Access' END AS mitre_tactic,
        CASE threat_type WHEN 'path_traversal' THEN 'T1083 - File and Directory Discovery'
            WHEN 'command_injection' THEN 'T1059 - Command and Scripting Interpreter'
            WHEN 'novel_probe' THEN 'AI Anomaly' ELSE 'T1190 - Exploit Public-Facing Application' END AS mitre_technique
    FROM logs WHERE threat_type <> 'benign'"""


@query(f"WITH {LOGS} {THREAT_ALERTS}")
def threat_alerts(spark, sf_dir):
    return alert_columns(detect_threats(logs(spark, sf_dir, "app")).alerts)


# --- correlation and annotation --------------------------------------------------------------

def _renamed(sql: str, prefix: str) -> str:
    """SQL over the CTEs of ``burst_ctes`` under a prefix."""
    return re.sub(r"\b(FROM|JOIN) (f|m|hit|ends)\b", rf"\1 {prefix}\2", sql).replace("ends AS", f"{prefix}ends AS").replace("hit AS", f"{prefix}hit AS")


# All alerts with their place in the list (rule, first appearance of the key, time), and their members.
ALERTS = f"""{burst_ctes(FAILED, "source_ip", AUTH_W, BURST_T, "auth_")}, {_renamed(_COMPROMISED.format(seconds=600), "auth_")},
    {burst_ctes(FILES, "source_ip", FILE_W, BURST_T, "file_")}, {_PROFILE_LINES}, {_ALL_ESCALATIONS}, {_ACCOUNT_BURST}, {FLOWS}, {SUSPICIOUS},
    listed AS (
        SELECT *, 0 AS rule_no, (SELECT min(event_idx) FROM auth_f k WHERE k.key = x.source_ip) AS key_first FROM ({_renamed(_BRUTE_FORCE_ALERTS, "auth_")}) x
        UNION ALL SELECT *, 1, alert_id FROM ({_NEW_SOURCE_ALERTS})
        UNION ALL SELECT *, 2, CASE severity WHEN 'critical' THEN 0 ELSE 1 END FROM ({_PRIVILEGE_ALERTS})
        UNION ALL SELECT *, 3, (SELECT min(event_idx) FROM file_f k WHERE k.key = x.source_ip) FROM ({_renamed(_FILE_ALERTS, "file_")}) x
        UNION ALL SELECT *, 4, alert_id FROM ({EXFIL_ALERTS})
        UNION ALL SELECT *, 5, alert_id FROM ({THREAT_ALERTS})),
    alerts AS (SELECT *, row_number() OVER (ORDER BY rule_no, key_first, alert_id) AS seq FROM listed),
    members AS (
        SELECT CAST(first_idx AS BIGINT) AS alert_id, event_idx FROM auth_m
        UNION ALL SELECT (CAST(1 AS BIGINT) << 56) | r.first_idx, l.event_idx FROM rare r JOIN logs l ON l.app = r.key
            WHERE {_PRIVILEGED.replace("severity", "l.severity")}
        UNION ALL SELECT (CAST(2 AS BIGINT) << 56) | event_idx, unnest([event_idx, success_idx, privilege_idx]) FROM esc
            WHERE success_idx IS NOT NULL AND privilege_idx IS NOT NULL
        UNION ALL SELECT (CAST(2 AS BIGINT) << 56) | min(m.event_idx) OVER (), m.event_idx
            FROM managed m JOIN first_run r ON m.rn BETWEEN r.first_rn AND r.last_rn
        UNION ALL SELECT (CAST(3 AS BIGINT) << 56) | first_idx, event_idx FROM file_m
        UNION ALL SELECT (CAST(4 AS BIGINT) << 56) | s.first_idx, l.event_idx FROM suspicious s
            JOIN logs l ON l.source_ip = s.src AND l.dest_ip = s.dst WHERE reason_count > 0
        UNION ALL SELECT (CAST(5 AS BIGINT) << 56) | event_idx, event_idx FROM logs WHERE threat_type <> 'benign'),
    refs AS (SELECT m.event_idx, a.rule_no, a.rule_name, a.severity, a.title FROM members m JOIN alerts a ON a.alert_id = m.alert_id)"""


def rule_alerts(spark, sf_dir):
    """Alerts and members of all six detectors, staged since several operators read them."""
    plain, by_app = logs(spark, sf_dir), logs(spark, sf_dir, "app")
    jobs = [
        lambda: detect_brute_force(plain, AUTH_W, BURST_T, "ip"),
        lambda: detect_new_source(by_app),
        lambda: detect_privilege_escalation(plain, DAY, None, burst_seconds=DAY),
        lambda: detect_file_access(plain, FILE_W, BURST_T),
        lambda: detect_exfiltration(plain, *_EXFIL),
        lambda: detect_threats(by_app),
    ]
    return staged_together(spark, together(spark, jobs))


@query(
    f"""WITH RECURSIVE {LOGS}, {ALERTS}, kinds AS (
        SELECT event_idx, rule_no, rule_name, rule_name || '/' || severity || '/' || title || ' x' || count(*) AS entry
        FROM refs GROUP BY event_idx, rule_no, rule_name, severity, title)
    SELECT event_idx, string_agg(entry, ';' ORDER BY entry) AS alerts,
        (SELECT string_agg(rule_name, ',' ORDER BY rule_no) FROM (SELECT DISTINCT k.rule_no, k.rule_name FROM kinds k WHERE k.event_idx = kinds.event_idx)) AS rules
    FROM kinds GROUP BY event_idx"""
)
def annotated_events(spark, sf_dir):
    refs = event_alerts(*rule_alerts(spark, sf_dir))
    text = F.transform("alerts", lambda a: F.concat(F.concat_ws("/", a["rule_name"], a["severity"], a["title"]), F.lit(" x"), a["times"]))
    return refs.select(
        "event_idx",
        F.array_join(F.array_sort(text), ";").alias("alerts"),
        F.array_join(F.array_distinct("alerts.rule_name"), ",").alias("rules"),
    )


@query(f"WITH RECURSIVE {LOGS}, {ALERTS} SELECT alert_id, event_idx FROM members")
def alert_members(spark, sf_dir):
    """The bridge table of all six detectors."""
    return rule_alerts(spark, sf_dir)[1]


ANNOTATED_LOGS = f"""{ALERTS}, ann AS (
    SELECT l.*, coalesce(r.rules, []) AS rules FROM logs l LEFT JOIN (
        SELECT event_idx, list(rule_name) AS rules FROM (SELECT DISTINCT * FROM refs) GROUP BY event_idx) r ON r.event_idx = l.event_idx)"""


def annotated_logs(spark, sf_dir):
    return annotate(logs(spark, sf_dir), *rule_alerts(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {LOGS}, {burst_ctes(FAILED, "source_ip", AUTH_W, BURST_T, "auth_")},
    {burst_ctes(FILES, "source_ip", FILE_W, BURST_T, "file_")}, {FLOWS}, {SUSPICIOUS}, {_ALL_ESCALATIONS},
    {_BURST.format(seconds=300)},
    profiles AS (SELECT source_ip, count(*) AS n FROM logs GROUP BY source_ip)
    SELECT 'brute_force' AS rule_name, count(*) AS alerts, CAST(coalesce(sum(n), 0) AS BIGINT) AS events
        FROM auth_w HAVING count(*) > 0
    UNION ALL SELECT 'file_access_anomaly', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM file_w HAVING count(*) > 0
    UNION ALL SELECT 'data_exfiltration', count(*), CAST(sum(packets) AS BIGINT) FROM suspicious WHERE reason_count > 0
        HAVING count(*) > 0
    UNION ALL SELECT 'privilege_escalation', sum(a), sum(e) FROM (
        SELECT count(*) AS a, 3 * count(*) AS e FROM esc WHERE success_idx IS NOT NULL AND privilege_idx IS NOT NULL
        UNION ALL SELECT count(*), CAST(coalesce(sum(last_rn - first_rn + 1), 0) AS BIGINT) FROM first_run)
        HAVING sum(a) > 0
    UNION ALL SELECT 'ai_anomaly', count(*), count(*) FROM logs WHERE threat_type <> 'benign' HAVING count(*) > 0
    UNION ALL SELECT 'new_ip', count(*), CAST(sum(k) AS BIGINT) FROM (
        SELECT l.source_ip, count(*) FILTER ({_PRIVILEGED}) AS k FROM logs l JOIN profiles p ON p.source_ip = l.source_ip
        WHERE p.n <= greatest(3.0, (SELECT avg(n) FROM profiles) * 0.1) GROUP BY l.source_ip) WHERE k > 0 HAVING count(*) > 0"""
)
def correlate_all(spark, sf_dir):
    """All six detectors over a built timeline: alerts and referenced events per rule."""
    source = logs(spark, sf_dir).drop("event_idx")
    found = correlate(build_timeline(source), CONFIG)
    alerts = found.alerts.groupBy("rule_name").agg(
        F.count("*").alias("alerts"), F.sum("event_count").alias("events")
    )
    return alerts
