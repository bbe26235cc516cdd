"""Bulk file access: bursts of file events per source, and mass deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtrail.functions.text import contains_any
from logtrail.operators.alerts import (
    UNKNOWN_KEYS,
    Detection,
    alert_identity,
    entity_key,
    event_line,
    evidence,
    window_bridge,
)
from logtrail.operators.windows import greedy_windows, largest_key, window_members
from logtrail.schema import conform_alerts
from logtrail.session import stage

# Ids and words of file events, and the share of deletions that looks like ransomware.
FILE_IDS = ("4663", "4656", "4660", "4670")
FILE_WORDS = ("file", "object access", "delete", "modify")
DELETION_SHARE = 0.3


def is_file_event() -> Column:
    return (
        (F.col("category") == "file_access")
        | F.col("event_id").isin(*FILE_IDS)
        | contains_any(F.lower("message"), FILE_WORDS)
    )


def is_deletion() -> Column:
    return (F.col("event_id") == "4660") | F.contains(F.lower("message"), F.lit("delete"))


def detect_file_access(
    events: DataFrame, window_seconds: int = 120, threshold: int = 10, entity: str = "ip", **limits: int
) -> Detection:
    """Alerts for ``threshold`` file events of one source within ``window_seconds``."""
    rows = (
        events.filter(is_file_event())
        .select(
            entity_key(entity).alias("key"),
            F.unix_micros("timestamp").alias("t"),
            "event_idx",
            "timestamp",
            "event_id",
            "message",
            "source_ip",
            "process",
        )
        .filter(~F.col("key").isin(*UNKNOWN_KEYS))
    )
    largest = largest_key(rows)
    starts = greedy_windows(rows, window_seconds, threshold, largest, **limits)
    members = stage(window_members(rows, starts, window_seconds), "file-bursts")
    windows = members.groupBy("key", "start", "first_idx").agg(
        F.count("*").alias("n"),
        F.count_if(is_deletion()).alias("deletions"),
        F.min_by(F.struct("timestamp", "source_ip", "process"), F.col("event_idx")).alias("first"),
        F.max_by("timestamp", "event_idx").alias("end_timestamp"),
    )
    key_order = rows.groupBy("key").agg(F.min("event_idx").alias("key_first"))
    full = windows.join(evidence(members, ["key", "start"], event_line(80)), ["key", "start"]).join(key_order, "key")
    ransom = F.col("deletions") > F.col("n") * F.lit(DELETION_SHARE)

    def either(yes: str, no: str) -> Column:
        return F.when(ransom, F.lit(yes)).otherwise(F.lit(no))

    alerts = full.withColumns(
        {
            **alert_identity("file_access_anomaly", F.col("key_first"), F.col("first_idx")),
            "severity": either("critical", "high"),
            "title": either("Possible Ransomware Activity", "Bulk File Access Anomaly"),
            "description": F.concat(
                F.lit("Detected "), F.col("n"), F.lit(" file operations by '"), F.col("key"),
                F.lit(f"' within {window_seconds}s."),
            ),
            "timestamp": F.col("first.timestamp"),
            "source_ip": F.col("first.source_ip"),
            "target": F.col("key"),
            "process": F.col("first.process"),
            "event_count": F.col("n"),
            "confidence": F.least(F.lit(0.6) + (F.col("n") - threshold) * F.lit(0.05), F.lit(0.95)),
            "mitre_tactic": either("Impact", "Collection"),
            "mitre_technique": either("T1486", "T1005"),
        }
    )
    return Detection(conform_alerts(alerts), window_bridge(members, "file_access_anomaly"))
