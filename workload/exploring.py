"""Summary, exploration and delivery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtrail.operators import explore as ex
from logtrail.operators import summary as sm
from logtrail.operators.annotate import annotate
from logtrail.sinks import deliverable, in_batches, run_status, to_json_rows
from workload.base import LOGS, logs, query
from workload.detection import (
    ALERTS,
    ANNOTATED_LOGS,
    rule_alerts,
)

RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END"
POINTS = "CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 15 WHEN 'medium' THEN 5 ELSE 1 END"
LEVEL = "CASE WHEN {s} >= 70 THEN 'critical' WHEN {s} >= 40 THEN 'high' WHEN {s} >= 15 THEN 'medium' ELSE 'low' END"


def alerts_of(spark, sf_dir):
    return rule_alerts(spark, sf_dir)[0]


# --- summary ---------------------------------------------------------------------------------


@query(
    f"""WITH {LOGS} SELECT 'severity' AS dimension, severity AS value, count(*) AS events FROM logs GROUP BY severity
    UNION ALL SELECT 'category', category, count(*) FROM logs GROUP BY category"""
)
def severity_and_category_counts(spark, sf_dir):
    return sm.event_counts(logs(spark, sf_dir))


@query(f"WITH RECURSIVE {LOGS}, {ALERTS} SELECT rule_name, count(*) AS alerts FROM alerts GROUP BY rule_name")
def rule_counts(spark, sf_dir):
    return sm.rule_counts(alerts_of(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {LOGS}, {ALERTS} SELECT coalesce(nullif(process, ''), source_ip) AS attacker, count(*) AS alert_count FROM alerts
    GROUP BY ALL ORDER BY alert_count DESC, min(seq) LIMIT 10"""
)
def top_attackers(spark, sf_dir):
    return sm.top_attackers(alerts_of(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {LOGS}, {ALERTS}, r AS (SELECT count(*) AS total_alerts,
        CAST(least(100, coalesce(sum({POINTS}), 0)) AS BIGINT) AS risk_score FROM alerts)
    SELECT *, {LEVEL.format(s="risk_score")} AS risk_level FROM r"""
)
def risk_score(spark, sf_dir):
    return sm.risk(alerts_of(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {LOGS}, {ALERTS}, r AS (SELECT count(*) AS total_alerts,
        CAST(least(100, coalesce(sum({POINTS}), 0)) AS BIGINT) AS risk_score FROM alerts)
    SELECT e.*, r.*, {LEVEL.format(s="risk_score")} AS risk_level FROM (
        SELECT count(*) AS total_events, min(epoch_us(timestamp)) AS start_us, max(epoch_us(timestamp)) AS end_us,
            count(DISTINCT source_file) AS source_file_count FROM logs) e, r"""
)
def run_overview(spark, sf_dir):
    status = run_status(logs(spark, sf_dir), alerts_of(spark, sf_dir))
    return status.withColumns({"start_us": F.unix_micros("start"), "end_us": F.unix_micros("end")}).drop("start", "end")


@query(
    f"""WITH RECURSIVE {LOGS}, {ALERTS}, r AS (SELECT CAST(make_timestamp(start_us) AS DATE) AS day, count(*) AS total_alerts,
        CAST(least(100, sum({POINTS})) AS BIGINT) AS risk_score FROM alerts WHERE rule_name = 'new_ip' GROUP BY day)
    SELECT *, {LEVEL.format(s="risk_score")} AS risk_level FROM r"""
)
def risk_by_day(spark, sf_dir):
    """The risk of one rule's alerts of each day, which is not always at its cap."""
    alerts = alerts_of(spark, sf_dir).filter("rule_name = 'new_ip'")
    per_day = alerts.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("total_alerts"), F.least(F.lit(sm.RISK_CAP), F.sum(sm.risk_points())).cast("bigint").alias("risk_score")
    )
    return per_day.withColumn("risk_level", sm.risk_level(F.col("risk_score")))


@query(f"WITH {LOGS} SELECT DISTINCT source_file FROM logs")
def source_files(spark, sf_dir):
    return sm.source_files(logs(spark, sf_dir))


@query(
    f"""WITH {LOGS}, per AS (SELECT username, CAST(least(100, sum({POINTS})) AS BIGINT) AS score FROM logs GROUP BY username)
    SELECT username, score, {LEVEL.format(s="score")} AS level FROM per"""
)
def risk_bands(spark, sf_dir):
    """The points and bands by user, to reach every band."""
    per_user = logs(spark, sf_dir).groupBy("username").agg(
        F.least(F.lit(sm.RISK_CAP), F.sum(sm.risk_points())).cast("bigint").alias("score")
    )
    return per_user.withColumn("level", sm.risk_level(F.col("score")))


# --- exploration -----------------------------------------------------------------------------

_SEARCH = """(contains(lower(message), 'u1') OR contains(lower(event_id), 'u1') OR contains(lower(source_ip), 'u1')
    OR contains(lower(username), 'u1') OR contains(lower(source), 'u1'))"""


@query(f"WITH {LOGS} SELECT event_idx, event_id, username FROM logs WHERE {_SEARCH}")
def search_events(spark, sf_dir):
    return ex.search(logs(spark, sf_dir), "U1").select("event_idx", "event_id", "username")


@query(
    f"WITH RECURSIVE {LOGS}, {ANNOTATED_LOGS} SELECT event_idx, event_id FROM ann WHERE list_contains(rules, 'data_exfiltration')"
)
def filter_by_rule(spark, sf_dir):
    found = ex.events_of_rule(logs(spark, sf_dir), *rule_alerts(spark, sf_dir), "data_exfiltration")
    return found.select("event_idx", "event_id")


@query(
    f"WITH {LOGS} SELECT event_idx FROM logs WHERE severity = 'high' AND category = 'authentication' AND {_SEARCH}"
)
def filter_events(spark, sf_dir):
    return ex.explore(logs(spark, sf_dir), "u1", severity="high", category="authentication").select("event_idx")


@query(
    f"""WITH {LOGS} SELECT event_idx, message FROM logs WHERE category = 'authentication'
    ORDER BY lower(message) DESC, event_idx LIMIT 50 OFFSET 100"""
)
def sorted_page(spark, sf_dir):
    filtered = ex.explore(logs(spark, sf_dir), category="authentication")
    return ex.page(filtered, number=3, sort_by="message", ascending=False).select("event_idx", "message")


@query(
    f"""WITH {LOGS}, r AS (SELECT *, row_number() OVER (ORDER BY lower(username), event_idx) - 1 AS rank FROM logs), n AS (SELECT count(*) AS n FROM logs)
    SELECT page, event_idx, message FROM r, n, (VALUES ('first', 4), ('middle', NULL), ('last', NULL)) p(page, number)
    WHERE rank // 50 = CASE page WHEN 'first' THEN 4 WHEN 'middle' THEN n // 100 ELSE (n - 1) // 50 END"""
)
def deep_page(spark, sf_dir):
    """Pages anywhere in one staged order, each read from the partitions that hold it."""
    index = ex.page_index(logs(spark, sf_dir), sort_by="username")
    numbers = {"first": 5, "middle": index.total // 100 + 1, "last": 10**9}
    out = None
    for name, number in numbers.items():
        page = index.page(number).select(F.lit(name).alias("page"), "event_idx", "message")
        out = page if out is None else out.unionByName(page)
    return out


@query(
    f"""WITH {LOGS}, c AS (SELECT count(*) AS total FROM logs WHERE category = 'network')
    SELECT total, CAST(ceil(total / 50.0) AS BIGINT) AS pages, CAST(ceil(total / 50.0) AS BIGINT) AS page,
        CAST((ceil(total / 50.0) - 1) * 50 + 1 AS BIGINT) AS first_row, total AS last_row FROM c"""
)
def page_numbers(spark, sf_dir):
    """A page far beyond the end is clamped to the last."""
    return ex.page_info(ex.explore(logs(spark, sf_dir), category="network"), number=10_000_000)


@query(
    f"""WITH RECURSIVE {LOGS}, {ALERTS} SELECT alert_id, severity, CAST({RANK} AS BIGINT) AS rank FROM alerts
    ORDER BY {RANK}, seq"""
)
def alerts_by_severity(spark, sf_dir):
    ordered = ex.alerts_by_severity(alerts_of(spark, sf_dir))
    return ordered.select(
        "alert_id", "severity", ex.severity_rank(F.col("severity")).cast("bigint").alias("rank")
    )


_NAMED = f"""named AS (
        SELECT *, CASE WHEN process <> '' THEN process || '::' || source_ip WHEN source_ip <> '' THEN source_ip
            ELSE 'Internal/Unknown' END AS identity FROM alerts)"""


@query(
    f"""WITH RECURSIVE {LOGS}, {ALERTS}, {_NAMED}
    SELECT identity, count(*) AS total, count(DISTINCT title) AS kinds,
        CASE min({RANK}) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS max_severity
    FROM named GROUP BY identity"""
)
def attacker_profiles(spark, sf_dir):
    return ex.attacker_profiles(alerts_of(spark, sf_dir)).select("identity", "total", "kinds", "max_severity")


@query(f"WITH RECURSIVE {LOGS}, {ALERTS}, {_NAMED} SELECT identity, title, count(*) AS alerts FROM named GROUP BY ALL")
def attacker_titles(spark, sf_dir):
    return ex.attacker_titles(alerts_of(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {LOGS}, {ALERTS}, cards(card_no, rule_name, label) AS (VALUES (0, 'brute_force', 'Brute Force'),
        (1, 'new_ip', 'New IP'), (2, 'privilege_escalation', 'Priv Escalation'), (3, 'file_access_anomaly', 'File Access'),
        (4, 'data_exfiltration', 'Data Exfil'))
    SELECT CAST(card_no AS BIGINT) AS card_no, c.rule_name, label,
        (SELECT count(*) FROM alerts a WHERE a.rule_name = c.rule_name) AS alerts FROM cards c"""
)
def zero_filled_counts(spark, sf_dir):
    cards = ex.detection_cards(sm.rule_counts(alerts_of(spark, sf_dir)))
    return cards.select(F.col("card_no").cast("bigint").alias("card_no"), "rule_name", "label", "alerts")


@query(
    f"""WITH RECURSIVE {LOGS}, {ALERTS} SELECT DISTINCT rule_name, CASE rule_name WHEN 'brute_force' THEN 'Brute Force' WHEN 'new_ip' THEN 'New IP'
        WHEN 'privilege_escalation' THEN 'Privilege Escalation' WHEN 'file_access_anomaly' THEN 'File Access Anomaly'
        WHEN 'data_exfiltration' THEN 'Data Exfiltration' ELSE replace(rule_name, '_', ' ') END AS label FROM alerts"""
)
def rules_present(spark, sf_dir):
    return ex.rules_present(alerts_of(spark, sf_dir))


_SAMPLE = f"""n AS (SELECT count(*) AS n, count(*) FILTER (len(rules) > 0) AS a FROM ann),
    step AS (SELECT CASE WHEN n <= 2000 THEN 0 WHEN a >= 2000 THEN -1 ELSE CAST(ceil(n / (2000.0 - a)) AS BIGINT) END AS k FROM n),
    sample AS (
        SELECT ann.* FROM ann, step WHERE k = 0 OR len(rules) > 0 OR (k > 0 AND event_idx % greatest(k, 1) = 0)
        ORDER BY CASE WHEN k = 0 OR len(rules) > 0 THEN 0 ELSE 1 END, event_idx LIMIT 2000)"""


def _sampled(spark, sf_dir):
    alerts, members = rule_alerts(spark, sf_dir)
    events = logs(spark, sf_dir)
    return ex.timeline_sample(annotate(events, alerts, members), totals=ex.alerted_totals(events, members))


@query(f"WITH RECURSIVE {LOGS}, {ANNOTATED_LOGS}, {_SAMPLE} SELECT event_idx, CAST(len(rules) AS BIGINT) AS alerts FROM sample")
def timeline_sample(spark, sf_dir):
    return _sampled(spark, sf_dir).select("event_idx", F.size("alerts").cast("bigint").alias("alerts"))


@query(
    f"""WITH RECURSIVE {LOGS}, {ANNOTATED_LOGS}, {_SAMPLE}
    SELECT event_idx, category AS lane, epoch_us(timestamp) AS start_us, event_id AS content,
        left(event_id || ': ' || message, 200) AS title, severity FROM sample"""
)
def timeline_items(spark, sf_dir):
    items = ex.timeline_items(_sampled(spark, sf_dir))
    return items.select("event_idx", "lane", F.unix_micros("start").alias("start_us"), "content", "title", "severity")


# --- delivery --------------------------------------------------------------------------------


@query(
    f"""WITH {LOGS} SELECT CAST(event_idx // 100 + 1 AS BIGINT) AS batch_number,
        CAST((SELECT ceil(count(*) / 100.0) FROM logs) AS BIGINT) AS total_batches, count(*) AS events, min(event_idx) AS first
    FROM logs GROUP BY 1"""
)
def delivery_batches(spark, sf_dir):
    return (
        in_batches(logs(spark, sf_dir))
        .groupBy("batch_number", "total_batches")
        .agg(F.count("*").alias("events"), F.min("event_idx").alias("first"))
    )


@query(f"WITH {LOGS} SELECT event_idx, 'message' AS kept, message FROM logs")
def delivered_raw_fields(spark, sf_dir):
    raw = F.create_map(F.lit("message"), F.col("message"), F.lit("raw_line"), F.col("message"), F.lit("raw_xml"), F.lit(""))
    delivered = deliverable(logs(spark, sf_dir).withColumn("raw_data", raw))
    return delivered.select(
        "event_idx",
        F.array_join(F.map_keys("raw_data"), ",").alias("kept"),
        F.try_element_at("raw_data", F.lit("message")).alias("message"),
    )


@query(
    f"""WITH {LOGS} SELECT '{{"event_idx":' || event_idx || ',"event_id":"' || event_id || '","source_ip":"' || source_ip
        || '","payload_size":' || payload_size || '}}' AS json FROM logs"""
)
def delivered_json(spark, sf_dir):
    return to_json_rows(logs(spark, sf_dir).select("event_idx", "event_id", "source_ip", "payload_size"))
