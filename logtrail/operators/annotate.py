"""Attach alert summaries to the events that alerts refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


NO_ALERTS = "array<struct<rule_name:string,severity:string,title:string,times:bigint>>"


def event_alerts(alerts: DataFrame, members: DataFrame) -> DataFrame:
    """Per referenced event: its alert summaries in alert order.

    Equal summaries (one success can close thousands of escalations) are counted
    in ``times`` before they meet, so the array holds one entry per distinct
    summary and stays short.
    """
    summaries = alerts.select("alert_id", "alert_seq", "rule_name", "severity", "title", "event_count")
    counted = (
        members.join(summaries, ["alert_id"])
        .groupBy("event_idx", "rule_name", "severity", "title")
        .agg(F.min("alert_seq").alias("seq"), F.count("*").alias("times"))
    )
    entry = F.struct("seq", "rule_name", "severity", "title", "times")
    return (
        counted.groupBy("event_idx")
        .agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
        .select(
            "event_idx",
            F.transform(
                "_entries", lambda e: F.struct(e["rule_name"], e["severity"], e["title"], e["times"])
            )
            .cast(NO_ALERTS)
            .alias("alerts"),
        )
    )


def annotate(events: DataFrame, alerts: DataFrame, members: DataFrame) -> DataFrame:
    """Events with ``alerts``; an empty array where no alert refers to the event."""
    return events.join(event_alerts(alerts, members), "event_idx", "left").withColumn(
        "alerts", F.coalesce("alerts", F.array().cast(NO_ALERTS))
    )
