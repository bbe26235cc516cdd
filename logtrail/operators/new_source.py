"""Rare sources that do something privileged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtrail.functions.text import contains_any, first_present
from logtrail.operators.alerts import Detection, alert_identity, event_line, evidence
from logtrail.schema import conform_alerts
from logtrail.session import stage

# Sources that say nothing, privileged event ids, and words of privileged messages.
IGNORED_SOURCES = ("", "N/A", "-", "127.0.0.1", "::1", "0.0.0.0")
PRIVILEGED_IDS = (
    "4672", "4673", "4674", "4720", "4726", "4728", "4732", "4719", "4739", "1102", "SUDO_COMMAND",
    "SSH_LOGIN_SUCCESS", "4624",
)
PRIVILEGED_WORDS = ("privilege", "admin", "root", "sudo")
MIN_RARE_COUNT = 3
RARE_SHARE = 0.1

SOURCE = ("process", "source_ip")


def source_key(entity: tuple[str, ...] = SOURCE) -> Column:
    """First non-empty identity of an event, '' if there is none."""
    return first_present(*[F.col(c) for c in entity])


def is_privileged() -> Column:
    return (
        F.col("event_id").isin(*PRIVILEGED_IDS)
        | F.col("severity").isin("high", "critical")
        | contains_any(F.lower("message"), PRIVILEGED_WORDS)
    )


def source_profiles(events: DataFrame, entity: tuple[str, ...] = SOURCE) -> DataFrame:
    """Per source: events, privileged events, index of the first event, and whether it is rare."""
    profiles = (
        events.withColumn("key", source_key(entity))
        .filter(~F.col("key").isin(*IGNORED_SOURCES))
        .groupBy("key")
        .agg(
            F.count("*").alias("n"),
            F.count_if(is_privileged()).alias("privileged"),
            F.min("event_idx").alias("first_idx"),
        )
    )
    staged = stage(profiles, "sources")
    limit = staged.agg(F.greatest(F.lit(float(MIN_RARE_COUNT)), F.avg("n") * F.lit(RARE_SHARE)))
    return staged.withColumn("rare", F.col("n") <= limit.scalar())


def detect_new_source(events: DataFrame, entity: tuple[str, ...] = SOURCE) -> Detection:
    """One alert per rare source with privileged events."""
    profiles = source_profiles(events, entity)
    rare = stage(profiles.filter(F.col("rare") & (F.col("privileged") > 0)), "rare-sources")
    # Rare sources have few events each; their staged table is small enough to broadcast or is not, as measured.
    rows = stage(
        events.select(
            source_key(entity).alias("key"), "event_idx", "timestamp", "event_id", F.left("message", F.lit(80)).alias("message"),
            "source_ip", "username", "hostname", "process", is_privileged().alias("is_privileged"),
        )
        .join(rare.select("key", "first_idx"), "key"),
        "rare-events",
    )
    members = rows.filter("is_privileged")
    first = rows.filter(F.col("event_idx") == F.col("first_idx")).drop("event_idx", "first_idx")
    alerts = (
        rare.join(first, "key")
        .join(evidence(members, ["key"], event_line(80)), "key")
        .withColumns(
            {
                **alert_identity("new_ip", F.col("first_idx"), F.col("first_idx")),
                "severity": F.lit("high"),
                "title": F.concat(F.lit("Suspicious New IP: "), F.col("key")),
                "description": F.concat(
                    F.lit("IP "), F.col("key"), F.lit(" appeared only "), F.col("n"),
                    F.lit(" time(s) but performed "), F.col("privileged"),
                    F.lit(" privileged action(s). This may indicate unauthorized access from an unknown source."),
                ),
                "end_timestamp": F.lit(None).cast("timestamp"),
                "target": first_present(F.col("hostname"), F.col("username")),
                "event_count": F.col("privileged"),
                "confidence": F.least(F.lit(0.6) + F.col("privileged") * F.lit(0.15), F.lit(0.95)),
                "mitre_tactic": F.lit("Initial Access"),
                "mitre_technique": F.lit("T1078 - Valid Accounts"),
            }
        )
    )
    alert_id = alert_identity("new_ip", F.col("first_idx"), F.col("first_idx"))["alert_id"]
    return Detection(conform_alerts(alerts), members.select(alert_id.alias("alert_id"), "event_idx"))
