"""Alerts for events whose message was labelled as an attack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtrail.functions.messages import CRITICAL_THREATS
from logtrail.functions.text import first_present
from logtrail.operators.alerts import Detection, alert_identity
from logtrail.schema import conform_alerts

# Tactic and technique of the threat labels, and the default.
MITRE = {
    "sql_injection": ("Initial Access", "T1190 - Exploit Public-Facing Application"),
    "xss": ("Initial Access", "T1190 - Exploit Public-Facing Application"),
    "path_traversal": ("Initial Access", "T1083 - File and Directory Discovery"),
    "command_injection": ("Execution", "T1059 - Command and Scripting Interpreter"),
}
OTHER_MITRE = ("Suspicious Activity", "AI Anomaly")


def detect_threats(events: DataFrame) -> Detection:
    """One alert per event with a threat label other than benign; no shuffle."""
    labelled = events.filter((F.col("threat_type") != "benign") & (F.col("threat_type") != ""))
    threat = F.col("threat_type")
    words = F.replace(threat, F.lit("_"), F.lit(" "))

    def mitre(i: int) -> Column:
        table = F.create_map(*[F.lit(x) for k, v in MITRE.items() for x in (k, v[i])])
        return F.coalesce(F.try_element_at(table, threat), F.lit(OTHER_MITRE[i]))

    application = (
        F.coalesce(F.try_element_at(F.col("raw_data"), F.lit("application_name")), F.lit(""))
        if "raw_data" in events.columns
        else F.lit("")
    )
    identity = alert_identity("ai_anomaly", F.col("event_idx"), F.col("event_idx"))
    alerts = labelled.withColumns(
        {
            **identity,
            "severity": F.when(threat.isin(*CRITICAL_THREATS), "critical").otherwise("high"),
            "title": F.concat(F.lit("AI Detection: "), F.initcap(words)),
            "description": F.concat(
                F.lit("Machine Learning model identified a highly suspicious "), words,
                F.lit(" pattern in the log message from "),
                F.coalesce(F.nullif(first_present(F.col("process"), F.col("source_ip")), F.lit("")), F.lit("unknown")),
                F.lit("."),
            ),
            "evidence": F.array(F.concat(F.lit("RAW: "), F.col("message"))),
            "end_timestamp": F.lit(None).cast("timestamp"),
            "target": first_present(application, F.col("hostname")),
            "event_count": F.lit(1).cast("bigint"),
            "confidence": F.lit(0.9),
            "mitre_tactic": mitre(0),
            "mitre_technique": mitre(1),
        }
    )
    return Detection(conform_alerts(alerts), labelled.select(identity["alert_id"].alias("alert_id"), "event_idx"))
