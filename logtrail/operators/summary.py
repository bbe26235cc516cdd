"""Distributions, top attackers, time range and risk score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtrail.functions.text import present

# Points per alert severity; any other severity counts one point.
RISK_POINTS = {"critical": 30, "high": 15, "medium": 5}
RISK_CAP = 100
TOP_ATTACKERS = 10


@dataclass
class Summary:
    """The parts of a summary, each a DataFrame."""

    overview: DataFrame
    event_counts: DataFrame
    rule_counts: DataFrame
    top_attackers: DataFrame
    source_files: DataFrame


def event_counts(events: DataFrame) -> DataFrame:
    """Events per severity and per category in one pass: ``dimension``, ``value``, ``events``."""
    return (
        events.groupingSets([["severity"], ["category"]], "severity", "category")
        .agg(F.count("*").alias("events"), F.grouping_id().alias("_level"))
        .select(
            F.when(F.col("_level") == 1, "severity").otherwise("category").alias("dimension"),
            F.when(F.col("_level") == 1, F.col("severity")).otherwise(F.col("category")).alias("value"),
            "events",
        )
    )


def rule_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("rule_name").agg(F.count("*").alias("alerts"))


def top_attackers(alerts: DataFrame, limit: int = TOP_ATTACKERS) -> DataFrame:
    """The sources (process, else address) with most alerts; ties by first appearance."""
    return (
        alerts.withColumn("attacker", F.coalesce(present(F.col("process")), present(F.col("source_ip"))))
        .filter("attacker IS NOT NULL")
        .groupBy("attacker")
        .agg(F.count("*").alias("alert_count"), F.min("alert_seq").alias("first_seq"))
        .orderBy(F.desc("alert_count"), "first_seq")
        .limit(limit)
        .select("attacker", "alert_count")
    )


def risk_points() -> Column:
    points = F.lit(1)
    for severity, value in RISK_POINTS.items():
        points = F.when(F.col("severity") == severity, F.lit(value)).otherwise(points)
    return points


def risk_level(score: Column) -> Column:
    """Bands of the risk score."""
    return F.when(score >= 70, "critical").when(score >= 40, "high").when(score >= 15, "medium").otherwise("low")


def risk(alerts: DataFrame) -> DataFrame:
    """One row: ``total_alerts``, ``risk_score`` and ``risk_level``."""
    score = F.least(F.lit(RISK_CAP), F.coalesce(F.sum(risk_points()), F.lit(0)))
    return alerts.agg(F.count("*").alias("total_alerts"), score.cast("bigint").alias("risk_score")).withColumn(
        "risk_level", risk_level(F.col("risk_score"))
    )


def event_totals(events: DataFrame) -> DataFrame:
    """One row: ``total_events``, ``start``, ``end`` and the number of source files."""
    return events.agg(
        F.count("*").alias("total_events"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.count_distinct(present(F.col("source_file"))).alias("source_file_count"),
    )


def source_files(events: DataFrame) -> DataFrame:
    return events.filter("source_file <> ''").select("source_file").distinct()


def overview(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row with the totals, the time range and the risk score."""
    scored = risk(alerts)
    return event_totals(events).withColumns(
        {c: scored.select(c).scalar() for c in ("total_alerts", "risk_score", "risk_level")}
    )


def summarize(events: DataFrame, alerts: DataFrame) -> Summary:
    return Summary(
        overview(events, alerts),
        event_counts(events),
        rule_counts(alerts),
        top_attackers(alerts),
        source_files(events),
    )
