"""Privilege escalation: failed login then success and privilege; bursts of account management."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtrail.functions.text import first_present
from logtrail.functions.times import iso_text, seconds_between
from logtrail.operators.alerts import UNKNOWN_KEYS, Detection, alert_identity, event_line
from logtrail.operators.ordering import first_following, in_blocks, with_ordinal
from logtrail.schema import FAILED_AUTH_IDS, SUCCESS_AUTH_IDS, conform_alerts
from logtrail.session import stage

# Ids of privilege use and of account management; limits of the account burst.
PRIVILEGE_IDS = ("4672", "4673", "SUDO_COMMAND")
ACCOUNT_IDS = ("4720", "4722", "4724", "4726", "4728", "4732")
LOOKAHEAD_ROWS = 199
BURST_SIZE = 5
BURST_MIN = 3
BURST_SECONDS = 300

_BLOCK_ROWS = 1_000_000


def escalations(
    events: DataFrame,
    window_seconds: int = 600,
    max_lookahead: int | None = LOOKAHEAD_ROWS,
    segment_rows: int = 100_000,
) -> DataFrame:
    """Failed logins whose source later succeeds and uses privilege in time.

    ``max_lookahead`` bounds the distance in timeline rows, counted over all sources.
    """
    key = first_present(F.col("process"), F.col("source_ip"), F.col("username"))
    event_id = F.col("event_id")
    picked = events.filter(event_id.isin(*FAILED_AUTH_IDS, *SUCCESS_AUTH_IDS, *PRIVILEGE_IDS)).select(
        key.alias("key"), "event_idx", "timestamp", "event_id", F.left("message", F.lit(60)).alias("message"),
        "source_ip", "username", "process",
    )
    later = F.struct("event_idx", "timestamp", "event_id", "username", "process")
    followed = first_following(
        picked.filter(~F.col("key").isin("", *UNKNOWN_KEYS)),
        "key",
        {
            "success": (event_id.isin(*SUCCESS_AUTH_IDS), later),
            "privilege": (event_id.isin(*PRIVILEGE_IDS), later),
        },
        segment_rows,
    )

    def in_time(c: str) -> Column:
        apart = seconds_between(F.col("timestamp"), F.col(f"{c}.timestamp"))
        near = F.coalesce(apart <= window_seconds, F.lit(True))
        if max_lookahead is not None:
            near = near & (F.col(f"{c}.event_idx") - F.col("event_idx") <= max_lookahead)
        return F.col(c).isNotNull() & near

    return followed.filter(event_id.isin(*FAILED_AUTH_IDS) & in_time("success") & in_time("privilege"))


def _escalation_alerts(found: DataFrame, window_seconds: int) -> DataFrame:
    def line(tag: str, c: str) -> Column:
        return F.concat(F.lit(f"{tag}: "), iso_text(F.col(f"{c}.timestamp")), F.lit(" - "), F.col(f"{c}.event_id"))

    time = iso_text(F.col("timestamp"))
    return conform_alerts(
        found.withColumns(
            {
                **alert_identity("privilege_escalation", F.lit(0).cast("bigint"), F.col("event_idx")),
                "severity": F.lit("critical"),
                "title": F.lit("Privilege Escalation Detected"),
                "description": F.concat(
                    F.lit("Source "), F.col("key"), F.lit(": Failed authentication at "), time,
                    F.lit(f", followed by successful logon and privilege elevation within {window_seconds}s."),
                ),
                "evidence": F.array(
                    F.concat(F.lit("FAIL: "), time, F.lit(" - "), F.col("event_id"), F.lit(": "), F.col("message")),
                    line("SUCCESS", "success"),
                    line("PRIVILEGE", "privilege"),
                ),
                "end_timestamp": F.col("privilege.timestamp"),
                "target": first_present(F.col("username"), F.col("success.username")),
                "process": first_present(F.col("privilege.process"), F.col("process")),
                "event_count": F.lit(3).cast("bigint"),
                "confidence": F.lit(0.85),
                "mitre_tactic": F.lit("Privilege Escalation"),
                "mitre_technique": F.lit("T1068 - Exploitation for Privilege Escalation"),
            }
        )
    )


def account_burst(events: DataFrame, seconds: int = BURST_SECONDS, block_rows: int = _BLOCK_ROWS) -> DataFrame:
    """Rows of the first account-management burst of the whole timeline, or none.

    A burst is a run of up to five (at least three) management events within ``seconds``;
    it is not keyed. Events are ranked globally and looked at in blocks.
    """
    managed = events.filter(F.col("event_id").isin(*ACCOUNT_IDS)).select(
        "event_idx", "timestamp", "event_id", "message", "process"
    )
    ranked = with_ordinal(managed, [F.col("event_idx")], "rn", "account-events")
    by_block = Window.partitionBy("_block").orderBy("rn")
    ends = [F.lead(F.struct("rn", "timestamp"), k).over(by_block) for k in range(BURST_SIZE - 1, BURST_MIN - 2, -1)]
    looked = in_blocks(ranked, "rn", block_rows, BURST_SIZE - 1).select(
        "rn", "timestamp", "_margin", F.coalesce(*ends).alias("end")
    )
    span = seconds_between(F.col("timestamp"), F.col("end.timestamp"))
    found = looked.filter(~F.col("_margin") & (span <= seconds))
    # one row, staged since three values of it are asked for
    first = stage(
        found.agg(F.min_by(F.struct("rn", F.col("end.rn").alias("last_rn"), span.alias("span")), F.col("rn")).alias("first")),
        "first-burst",
    )

    def of_first(name: str) -> Column:
        return first.select(F.col("first")[name]).scalar()

    return ranked.withColumn("span", of_first("span")).filter(
        (F.col("rn") >= of_first("rn")) & (F.col("rn") <= of_first("last_rn"))
    )


def _burst_alert(burst: DataFrame) -> DataFrame:
    # At most five rows, so one array holds them.
    row = F.struct("event_idx", "timestamp", "process", event_line(60).alias("line"))
    one = burst.groupBy().agg(
        F.sort_array(F.collect_list(row)).alias("rows"), F.first("span").alias("span"), F.count("*").alias("event_count")
    )
    rows = F.col("rows")
    return conform_alerts(
        one.filter("event_count > 0").withColumns(
            {
                **alert_identity("privilege_escalation", F.lit(1).cast("bigint"), rows[0]["event_idx"]),
                "severity": F.lit("high"),
                "title": F.lit("Rapid Account Manipulation"),
                "description": F.concat(
                    F.lit("Detected "), F.col("event_count"), F.lit(" account management operations within "),
                    F.bround("span", 0).cast("bigint"), F.lit("s."),
                ),
                "evidence": F.transform(rows, lambda r: r["line"]),
                "timestamp": rows[0]["timestamp"],
                "end_timestamp": F.element_at(rows, -1)["timestamp"],
                "source_ip": F.lit(""),
                "target": F.lit(""),
                "process": rows[0]["process"],
                "confidence": F.lit(0.75),
                "mitre_tactic": F.lit("Persistence"),
                "mitre_technique": F.lit("T1136 - Create Account"),
            }
        )
    )


def detect_privilege_escalation(
    events: DataFrame,
    window_seconds: int = 600,
    max_lookahead: int | None = LOOKAHEAD_ROWS,
    burst_seconds: int = BURST_SECONDS,
) -> Detection:
    """Alerts of both patterns; those of account management come last."""
    found = stage(escalations(events, window_seconds, max_lookahead), "escalations")
    burst = stage(account_burst(events, burst_seconds), "account-burst")
    burst_alert = _burst_alert(burst)
    escalation_id = alert_identity("privilege_escalation", F.lit(0), F.col("event_idx"))["alert_id"]
    triple = F.array("event_idx", "success.event_idx", "privilege.event_idx")
    members = found.select(escalation_id.alias("alert_id"), F.explode(triple).alias("event_idx")).unionByName(
        burst.select(burst_alert.select("alert_id").scalar().alias("alert_id"), "event_idx")
    )
    return Detection(_escalation_alerts(found, window_seconds).unionByName(burst_alert), members)
