"""What the detectors share: keys, evidence, alert identity, membership."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtrail.functions.text import present
from logtrail.functions.times import iso_text

# Rules in the order in which their alerts are listed.
RULES = (
    "brute_force",
    "new_ip",
    "privilege_escalation",
    "file_access_anomaly",
    "data_exfiltration",
    "ai_anomaly",
)
UNKNOWN_KEYS = ("unknown", "-", "N/A")
EVIDENCE_LINES = 10

# Which identity a detector keys on first.
ENTITY_ORDER = {
    "process": ("process", "source_ip", "username"),
    "ip": ("source_ip", "username", "process"),
    "user": ("username", "source_ip", "process"),
}
_RULE_SHIFT = 56


@dataclass
class Detection:
    """Alerts of one detector, and the bridge table from alerts to their events.

    An alert can span any number of events, so the full set is kept as rows
    (``alert_id``, ``event_idx``) and never as one array.
    """

    alerts: DataFrame
    members: DataFrame


def entity_key(entity: str = "process") -> Column:
    """First non-empty identity of an event, ``unknown`` if there is none."""
    return F.coalesce(*[present(F.col(c)) for c in ENTITY_ORDER[entity]], F.lit("unknown"))


def alert_identity(rule: str, key_first: Column, first_idx: Column) -> dict[str, Column]:
    """``alert_id`` and ``alert_seq``.

    No two alerts of a rule share their first event, so the rule number and that
    event's index make an id without a global count. ``alert_seq`` sorts alerts by
    rule, by first appearance of their key, then by time.
    """
    number = RULES.index(rule)
    return {
        "alert_id": F.lit(number << _RULE_SHIFT).cast("bigint").bitwiseOR(first_idx),
        "alert_seq": F.struct(
            F.lit(number).alias("rule_no"), key_first.alias("key_first_idx"), first_idx.alias("first_idx")
        ),
        "rule_name": F.lit(rule),
    }


def event_line(message_chars: int) -> Column:
    """One evidence line of an event."""
    return F.concat(
        iso_text(F.col("timestamp")), F.lit(" - "), F.col("event_id"), F.lit(": "), F.left("message", F.lit(message_chars))
    )


def evidence(members: DataFrame, keys: list[str], line: Column) -> DataFrame:
    """The first ten lines per group. The rank filter is applied before the shuffle as well."""
    first = Window.partitionBy(*keys).orderBy("event_idx")
    return (
        members.select(*keys, "event_idx", line.alias("_line"), F.row_number().over(first).alias("_n"))
        .filter(F.col("_n") <= EVIDENCE_LINES)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("event_idx", "_line"))).alias("_lines"))
        .select(*keys, F.transform("_lines", lambda x: x["_line"]).alias("evidence"))
    )


def window_bridge(members: DataFrame, rule: str) -> DataFrame:
    """(alert_id, event_idx) of alerts that are windows of a key; members know their window's first event."""
    alert_id = alert_identity(rule, F.col("first_idx"), F.col("first_idx"))["alert_id"]
    return members.select(alert_id.alias("alert_id"), "event_idx")
