"""Brute force: bursts of failed authentication per source."""

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
from logtrail.operators.windows import greedy_windows, largest_key, micros, window_members
from logtrail.schema import FAILED_AUTH_IDS, SUCCESS_AUTH_IDS, conform_alerts
from logtrail.session import stage

FAILURE_WORDS = ("failed", "failure", "denied", "invalid")
SUCCESS_SECONDS = 600


def is_failed_auth() -> Column:
    """Failed authentication by event id, or by the words of an authentication message."""
    return F.col("event_id").isin(*FAILED_AUTH_IDS) | (
        (F.col("category") == "authentication") & contains_any(F.lower("message"), FAILURE_WORDS)
    )


def failed_auth(events: DataFrame, entity: str = "process") -> DataFrame:
    """Failed authentication events with their source ``key`` and time ``t``."""
    return (
        events.filter(is_failed_auth())
        .withColumns({"key": entity_key(entity), "t": F.unix_micros("timestamp")})
        .filter(~F.col("key").isin(*UNKNOWN_KEYS))
    )


def followed_by_success(
    windows: DataFrame, events: DataFrame, seconds: int = SUCCESS_SECONDS, after_only: bool = False
) -> DataFrame:
    """``windows`` (``key``, ``last_t``) that have a successful login of source ip ``key`` nearby.

    Successes are first reduced to the earliest and latest per (ip, bucket of
    ``seconds``); the nearest one of a neighbouring bucket decides, so one popular
    address costs at most one row per bucket. Counts before as well as after the
    last failure unless ``after_only``.
    """
    width = micros(seconds)
    t = F.unix_micros("timestamp")
    successes = (
        events.filter(F.col("event_id").isin(*SUCCESS_AUTH_IDS) & (F.col("source_ip") != "") & t.isNotNull())
        .groupBy(F.col("source_ip").alias("key"), F.floor(t / width).cast("bigint").alias("_bucket"))
        .agg(F.min(t).alias("first_t"), F.max(t).alias("last_success_t"))
    )
    bucket = F.floor(F.col("last_t") / width).cast("bigint")
    near = windows.withColumn("_own", bucket).withColumn(
        "_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1))
    )
    lower = F.col("last_t") if after_only else F.col("last_t") - width
    hit = (F.col("last_success_t") >= lower) & (F.col("first_t") <= F.col("last_t") + width)
    return near.join(successes, ["key", "_bucket"]).filter(hit).select("key", "start").distinct()


def detect_brute_force(
    events: DataFrame,
    window_seconds: int = 300,
    threshold: int = 5,
    entity: str = "process",
    success_after_only: bool = False,
    **limits: int,
) -> Detection:
    """Alerts for ``threshold`` failed logins of one source within ``window_seconds``."""
    rows = failed_auth(events, entity).select(
        "key", "t", "event_idx", "timestamp", "event_id", "message", "source_ip", "username", "process"
    )
    largest = largest_key(rows)
    starts = greedy_windows(rows, window_seconds, threshold, largest, **limits)
    members = stage(window_members(rows, starts, window_seconds), "auth-bursts")
    windows = members.groupBy("key", "start", "first_idx").agg(
        F.count("*").alias("n"),
        F.max("t").alias("last_t"),
        F.min_by(F.struct("timestamp", "username", "process"), F.col("event_idx")).alias("first"),
        F.max_by(F.struct("timestamp", "source_ip"), F.col("event_idx")).alias("last"),
    )
    key_order = rows.groupBy("key").agg(F.min("event_idx").alias("key_first"))
    compromised = followed_by_success(
        windows.select("key", "start", "last_t"), events, after_only=success_after_only
    ).withColumn("success", F.lit(True))
    full = (
        windows.join(compromised, ["key", "start"], "left")
        .join(evidence(members, ["key", "start"], event_line(80)), ["key", "start"])
        .join(key_order, "key")
    )
    success = F.coalesce("success", F.lit(False))
    user = F.col("first.username")
    identity = alert_identity("brute_force", F.col("key_first"), F.col("first_idx"))
    alerts = full.withColumns(
        {
            **identity,
            "severity": F.when(success, "critical").otherwise("high"),
            "title": F.lit("Brute Force Attack Detected"),
            "description": F.concat(
                F.lit("Detected "),
                F.col("n"),
                F.lit(" failed authentication attempts from "),
                F.col("key"),
                F.lit(f" within {window_seconds}s"),
                F.when(success, F.lit(" — FOLLOWED BY SUCCESSFUL LOGIN (possible compromise)")).otherwise(""),
                F.when(user != "", F.concat(F.lit(" targeting user '"), user, F.lit("'"))).otherwise(""),
            ),
            "timestamp": F.col("first.timestamp"),
            "end_timestamp": F.col("last.timestamp"),
            "source_ip": F.col("last.source_ip"),
            "target": F.when(user != "", user).otherwise("unknown"),
            "process": F.col("first.process"),
            "event_count": F.col("n"),
            "confidence": F.least(F.lit(0.5) + (F.col("n") - threshold) * F.lit(0.1), F.lit(1.0)),
            "mitre_tactic": F.lit("Credential Access"),
            "mitre_technique": F.lit("T1110 - Brute Force"),
        }
    )
    return Detection(conform_alerts(alerts), window_bridge(members, "brute_force"))

