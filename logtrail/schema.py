"""The unified event schema, the alert schema and the auth event-id sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("ts_raw", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("raw_data", T.MapType(T.StringType(), T.StringType())),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("process", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("application", T.StringType()),
        T.StructField("threat_type", T.StringType()),
        T.StructField("payload_size", T.LongType()),
        T.StructField("service", T.StringType()),
        T.StructField("dns_query", T.StringType()),
        T.StructField("dst_ip_raw", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("tcp_flags", T.StringType()),
        T.StructField("file_seq", T.IntegerType()),
        T.StructField("row_no", T.LongType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("alert_id", T.LongType()),
        T.StructField(
            "alert_seq",
            T.StructType(
                [
                    T.StructField("rule_no", T.IntegerType()),
                    T.StructField("key_first_idx", T.LongType()),
                    T.StructField("first_idx", T.LongType()),
                ]
            ),
        ),
        T.StructField("rule_name", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("end_timestamp", T.TimestampType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("process", T.StringType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("mitre_tactic", T.StringType()),
        T.StructField("mitre_technique", T.StringType()),
    ]
)

# Event ids of failed and successful authentication.
FAILED_AUTH_IDS = ("4625", "4771", "SSH_LOGIN_FAILED", "PAM_AUTH_FAIL", "AUTH_FAILED", "SUDO_DENIED")
SUCCESS_AUTH_IDS = ("4624", "SSH_LOGIN_SUCCESS", "AUTH_SUCCESS", "PAM_SESSION_OPEN")

SEVERITIES = ("critical", "high", "medium", "low", "info")

_TEXT_DEFAULT = T.StringType()


def to_event_schema(df: DataFrame) -> DataFrame:
    """Project any event-like frame onto ``EVENT_SCHEMA``; text fields are never NULL."""
    present = set(df.columns)

    def field(f: T.StructField) -> Column:
        value = F.col(f.name).cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)
        if f.dataType == _TEXT_DEFAULT and f.name != "ts_raw":
            value = F.coalesce(value, F.lit("benign" if f.name == "threat_type" else ""))
        return value.alias(f.name)

    return df.select(*[field(f) for f in EVENT_SCHEMA.fields])


def conform_alerts(df: DataFrame) -> DataFrame:
    """Project an alert frame onto ``ALERT_SCHEMA``."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ALERT_SCHEMA.fields])
