"""Data exfiltration: outbound flows with much data, many packets or many DNS names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtrail.functions.network import is_private_ip
from logtrail.functions.text import first_present, present
from logtrail.functions.times import iso_text, seconds_between
from logtrail.operators.alerts import Detection, alert_identity, evidence
from logtrail.schema import conform_alerts
from logtrail.session import stage

# Limits of the DNS tunnelling reason.
DNS_QUERIES = 20
DNS_NAMES = 15

FLOW = ["flow_process", "src", "dst"]
#: Parts that the rows of one flow are spread over when they meet its row.
SALTS = 16


def outbound(events: DataFrame) -> DataFrame:
    """Network events from a private to a public address, with their flow key."""
    dest = first_present(F.col("dest_ip"), F.col("dst_ip_raw")) if "dst_ip_raw" in events.columns else F.col("dest_ip")
    named = events.filter(F.col("category") == "network").withColumns(
        {"src": F.col("source_ip"), "dst": dest, "flow_process": F.coalesce(present(F.col("process")), F.lit("unknown"))}
    )
    return named.filter(
        (F.col("src") != "") & (F.col("dst") != "") & is_private_ip("src") & ~is_private_ip("dst")
    )


def flows(events: DataFrame) -> DataFrame:
    """Per (process, source, destination): bytes, packets, time span and DNS names.

    All aggregates are numbers, so they run as hash aggregation; the process of
    the first event is the flow's own, except that an empty one is ``unknown``.
    """
    dns = present(F.col("dns_query"))
    timed = F.when(F.col("timestamp").isNotNull(), F.col("event_idx"))
    named = F.col("flow_process") != "unknown"
    return (
        outbound(events)
        .groupBy(*FLOW)
        .agg(
            F.sum(F.coalesce("payload_size", F.lit(0))).alias("bytes"),
            F.count("*").alias("packets"),
            F.min("event_idx").alias("first_idx"),
            F.min_by("timestamp", timed).alias("first_ts"),
            F.max_by("timestamp", "event_idx").alias("last_ts"),
            F.min(F.when(F.col("process") == "unknown", F.col("event_idx"))).alias("first_unknown"),
            F.count(dns).alias("dns_queries"),
            F.count_distinct(dns).alias("dns_names"),
        )
        .withColumn(
            "process",
            F.when(named | (F.col("first_unknown") == F.col("first_idx")), F.col("flow_process")).otherwise(""),
        )
        .drop("first_unknown")
    )


def flow_services(events: DataFrame) -> DataFrame:
    """Services seen per flow, one row each."""
    return outbound(events).filter(F.col("service") != "").groupBy(*FLOW, "service").agg(F.count("*").alias("packets"))


def suspicious_flows(
    flow_table: DataFrame, bytes_threshold: int = 50_000, packet_threshold: int = 50, window_seconds: int = 300
) -> DataFrame:
    """Flows with at least one reason, and the ``reasons``."""
    span = seconds_between(F.col("first_ts"), F.col("last_ts"))
    reasons = F.array(
        F.when(
            F.col("bytes") >= bytes_threshold,
            F.concat(F.lit("Large data transfer: "), F.format_number("bytes", 0), F.lit(" bytes")),
        ),
        F.when(
            (F.col("packets") >= packet_threshold) & (span <= window_seconds),
            F.concat(
                F.lit("High packet volume: "), F.col("packets"), F.lit(" packets in "),
                F.bround(span, 0).cast("bigint"), F.lit("s"),
            ),
        ),
        F.when(
            (F.col("dns_queries") >= DNS_QUERIES) & (F.col("dns_names") >= DNS_NAMES),
            F.concat(F.lit("Possible DNS tunneling: "), F.col("dns_names"), F.lit(" unique DNS queries")),
        ),
    )
    return flow_table.withColumn("reasons", F.array_compact(reasons)).filter(F.size("reasons") > 0)


def detect_exfiltration(
    events: DataFrame, bytes_threshold: int = 50_000, packet_threshold: int = 50, window_seconds: int = 300
) -> Detection:
    """One critical alert per suspicious flow."""
    found = stage(suspicious_flows(flows(events), bytes_threshold, packet_threshold, window_seconds), "flows")
    identity = alert_identity("data_exfiltration", F.col("first_idx"), F.col("first_idx"))
    line: Column = F.concat(iso_text(F.col("timestamp")), F.lit(" - "), F.left("message", F.lit(80)))
    # a flow may hold most rows: its row is laid out once per salt, so that a shuffled join spreads the rows over them
    salt = F.pmod("event_idx", F.lit(SALTS)).cast("int")
    packets = outbound(events).select(*FLOW, "event_idx", line.alias("line"), salt.alias("_salt"))
    spread = found.select(*FLOW, "first_idx", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    members = stage(packets.join(spread, [*FLOW, "_salt"]).drop("_salt"), "flow-packets")
    alerts = found.join(evidence(members, FLOW, F.col("line")), FLOW).withColumns(
        {
            **identity,
            "severity": F.lit("critical"),
            "title": F.concat(F.lit("Potential Data Exfiltration to "), F.col("dst")),
            "description": F.concat(
                F.lit("Suspicious outbound traffic from "), F.col("src"), F.lit(" → "), F.col("dst"), F.lit(": "),
                F.array_join("reasons", "; "),
            ),
            "timestamp": F.col("first_ts"),
            "end_timestamp": F.col("last_ts"),
            "source_ip": F.col("src"),
            "target": F.col("dst"),
            "event_count": F.col("packets"),
            "confidence": F.least(F.lit(0.5) + F.size("reasons") * F.lit(0.2), F.lit(0.95)),
            "mitre_tactic": F.lit("Exfiltration"),
            "mitre_technique": F.lit("T1048 - Exfiltration Over Alternative Protocol"),
        }
    )
    return Detection(conform_alerts(alerts), members.select(identity["alert_id"].alias("alert_id"), "event_idx"))
