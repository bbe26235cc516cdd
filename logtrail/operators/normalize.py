"""Raw records of each format to the unified event schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtrail.functions.messages import (
    application_name,
    details_text,
    first_ipv4,
    first_port,
    message_username,
    threat_severity,
)
from logtrail.functions.text import column, contains_any, first_present, present
from logtrail.functions.times import epoch_error, generic_timestamp, iso_error, windows_timestamp
from logtrail.schema import to_event_schema
from logtrail.sources.csv import ORIGIN_COLUMNS

# Column names that mean the same field, in order of preference.
CSV_SYNONYMS = {
    "timestamp": (
        "timestamp", "time", "date", "datetime", "created", "timecreated", "event_time", "log_time",
        "received_time", "@timestamp",
    ),
    "event_id": ("event_id", "eventid", "id", "event_code", "code", "rule_id", "alert_id"),
    "message": (
        "message", "msg", "description", "detail", "details", "summary", "event_message", "log_message",
        "text", "info",
    ),
    "category": ("category", "type", "event_type", "class", "log_type"),
    "severity": ("severity", "level", "priority", "risk", "alert_level"),
    "source_ip": ("source_ip", "src_ip", "src", "source_address", "client_ip", "remote_ip"),
    "dest_ip": ("dest_ip", "dst_ip", "dst", "destination_address", "target_ip", "server_ip"),
    "username": ("username", "user", "account", "user_name", "target_user", "actor"),
}
CATEGORY_WORDS = (
    ("authentication", ("auth", "login", "logon", "password")),
    ("network", ("net", "connection", "traffic", "flow")),
    ("file_access", ("file", "access", "object")),
)
SEVERITY_WORDS = (
    ("critical", ("critical", "crit", "fatal", "emergency")),
    ("high", ("high", "error", "err")),
    ("medium", ("medium", "med", "warning", "warn")),
    ("low", ("low",)),
)

# What the Windows event ids mean (id, category, severity, description).
WINDOWS_EVENTS = (
    ("1102", "system", "critical", "Audit log cleared"),
    ("400", "system", "info", "PowerShell engine started"),
    ("403", "system", "info", "PowerShell engine stopped"),
    ("4104", "system", "medium", "PowerShell script block logging"),
    ("4624", "authentication", "info", "Successful logon"),
    ("4625", "authentication", "high", "Failed logon attempt"),
    ("4634", "authentication", "info", "Account logoff"),
    ("4647", "authentication", "info", "User-initiated logoff"),
    ("4648", "authentication", "medium", "Logon using explicit credentials"),
    ("4656", "file_access", "info", "Handle to object requested"),
    ("4658", "file_access", "info", "Handle to object closed"),
    ("4660", "file_access", "medium", "Object deleted"),
    ("4663", "file_access", "info", "Object access attempted"),
    ("4670", "file_access", "medium", "Permissions on object changed"),
    ("4672", "authentication", "medium", "Special privileges assigned to logon"),
    ("4673", "authentication", "high", "Privileged service called"),
    ("4674", "authentication", "medium", "Operation attempted on privileged object"),
    ("4688", "system", "info", "New process created"),
    ("4689", "system", "info", "Process exited"),
    ("4697", "system", "high", "Service installed"),
    ("4719", "system", "critical", "System audit policy changed"),
    ("4720", "system", "high", "User account created"),
    ("4722", "system", "medium", "User account enabled"),
    ("4723", "authentication", "medium", "Password change attempted"),
    ("4724", "authentication", "high", "Password reset attempted"),
    ("4725", "system", "medium", "User account disabled"),
    ("4726", "system", "high", "User account deleted"),
    ("4728", "system", "high", "Member added to security-enabled global group"),
    ("4732", "system", "high", "Member added to security-enabled local group"),
    ("4735", "system", "medium", "Security-enabled local group changed"),
    ("4739", "system", "high", "Domain policy changed"),
    ("4740", "authentication", "high", "Account locked out"),
    ("4756", "system", "high", "Member added to universal group"),
    ("4768", "authentication", "info", "Kerberos TGT requested"),
    ("4769", "authentication", "info", "Kerberos service ticket requested"),
    ("4771", "authentication", "high", "Kerberos pre-authentication failed"),
    ("4776", "authentication", "info", "NTLM authentication attempt"),
    ("5156", "network", "info", "WFP connection allowed"),
    ("5157", "network", "medium", "WFP connection blocked"),
    ("7045", "system", "high", "New service installed"),
)
LOGON_TYPES = {
    "2": "Interactive",
    "3": "Network",
    "4": "Batch",
    "5": "Service",
    "7": "Unlock",
    "8": "NetworkCleartext",
    "9": "NewCredentials",
    "10": "RemoteInteractive (RDP)",
    "11": "CachedInteractive",
}
SENSITIVE_PORTS = (22, 3389, 445)
LARGE_PAYLOAD = 10_000


def with_labels(df: DataFrame, models=None) -> DataFrame:
    """Add ``source_label`` and ``threat_type`` of the column ``message``.

    Without models the labels are ``unknown`` and ``benign``.
    """
    if models is not None:
        return models.label(df, "message")
    return df.withColumns({"source_label": F.lit("unknown"), "threat_type": F.lit("benign")})


def _enriched(df: DataFrame) -> DataFrame:
    """Application, port, details, final source and severity from message and labels."""
    with_app = df.withColumn("application", application_name(F.col("message"), F.col("source_label")))
    threat = F.col("threat_type")
    return with_app.withColumns(
        {
            "details": details_text(F.col("application"), first_port(F.col("message")), threat),
            "severity": threat_severity(threat, F.col("severity")),
            "source": F.when(F.col("source_label") != "unknown", F.col("source_label")).otherwise(F.col("source_file")),
        }
    )


def _or_parse_error(events: DataFrame, reason: Column, timestamp: Column | None = None) -> DataFrame:
    """Events where a record with a ``reason`` is a ``PARSE_ERROR`` event of its file instead.

    Such an event keeps the raw record and the raw time; its time is ``timestamp``, by default none.
    """
    marked = events.withColumn("_reason", reason)
    instead = {
        "timestamp": F.lit(None).cast("timestamp") if timestamp is None else timestamp,
        "source": F.col("source_file"),
        "event_id": F.lit("PARSE_ERROR"),
        "category": F.lit("system"),
        "severity": F.lit("low"),
        "message": F.concat(F.lit("Normalization error: "), F.col("_reason")),
        "threat_type": F.lit("benign"),
    }
    for name in ("source_ip", "dest_ip", "username", "hostname", "process", "details"):
        if name in marked.columns:
            instead[name] = F.lit("")
    failed = F.col("_reason").isNotNull()
    return marked.withColumns({c: F.when(failed, value).otherwise(F.col(c)) for c, value in instead.items() if c in marked.columns}).drop("_reason")


def normalize_syslog(parsed: DataFrame, models=None) -> DataFrame:
    """Parsed syslog records to events; a time that no calendar holds gives a ``PARSE_ERROR`` event."""
    raw_columns = [c for c in ("hostname", "process", "pid", "category", "severity_hint") if c in parsed.columns]
    raw_message, process = F.col("message"), F.col("process")
    base = parsed.select(
        "timestamp",
        "ts_raw",
        "event_id",
        "category",
        F.col("severity_hint").alias("severity"),
        "hostname",
        "process",
        "source_file",
        "file_seq",
        "row_no",
        raw_message.alias("raw_message"),
        F.when(
            (process != "") & ~F.contains(raw_message, process),
            F.concat(F.lit("["), process, F.lit("] "), raw_message),
        )
        .otherwise(raw_message)
        .alias("message"),
        F.create_map(
            *[F.lit(x) if i == 0 else x for c in raw_columns for i, x in enumerate((c, F.col(c)))],
            F.lit("message"),
            raw_message,
        ).alias("raw_data"),
    )
    labelled = with_labels(base, models).withColumns(
        {
            "source_ip": first_present(first_ipv4(F.col("raw_message")), first_ipv4(F.col("message"))),
            "username": message_username(F.col("raw_message")),
        }
    )
    return to_event_schema(_or_parse_error(_enriched(labelled), iso_error(F.col("ts_raw"))))


def _matched(value: Column, table: tuple, default: Column) -> Column:
    out = default
    for name, words in reversed(table):
        out = F.when(contains_any(value, words), F.lit(name)).otherwise(out)
    return out


def normalize_csv(records: DataFrame, ingest_ts: Column | None = None, models=None) -> DataFrame:
    """Records of a delimited file to events; fields are found by synonymous column names.

    A time that is a number or date no calendar holds gives a ``PARSE_ERROR`` event.
    """
    ingest_ts = F.current_timestamp() if ingest_ts is None else ingest_ts
    names = [c for c in records.columns if c not in ORIGIN_COLUMNS]

    def pick(field: str) -> Column:
        return first_present(*[column(c) for c in CSV_SYNONYMS[field] if c in names])

    keyed = {*CSV_SYNONYMS["timestamp"], *CSV_SYNONYMS["event_id"]}
    pairs = [
        F.concat(F.lit(f"{c}="), present(column(c))) for c in names if c not in keyed and not c.startswith("_")
    ]
    fallback = (
        F.array_join(F.slice(F.filter(F.array(*pairs), lambda p: p.isNotNull()), 1, 5), " | ") if pairs else F.lit("")
    )
    category, severity = F.lower(pick("category")), F.lower(pick("severity"))
    base = records.select(
        generic_timestamp(pick("timestamp"), ingest_ts).alias("timestamp"),
        pick("timestamp").alias("ts_raw"),
        F.coalesce(present(pick("event_id")), F.lit("CSV_EVENT")).alias("event_id"),
        F.coalesce(present(pick("message")), fallback).alias("message"),
        F.when(category == "", F.lit("system"))
        .otherwise(_matched(category, CATEGORY_WORDS, category))
        .alias("category"),
        _matched(severity, SEVERITY_WORDS, F.lit("info")).alias("severity"),
        pick("source_ip").alias("given_ip"),
        pick("dest_ip").alias("dest_ip"),
        pick("username").alias("username"),
        (
            F.create_map(*[x for c in names if not c.startswith("_") for x in (F.lit(c), column(c))])
            if names
            else F.create_map().cast("map<string,string>")
        ).alias("raw_data"),
        *ORIGIN_COLUMNS,
        *_promoted(names),
    )
    labelled = with_labels(base, models).withColumn(
        "source_ip", first_present(F.col("given_ip"), first_ipv4(F.col("message")))
    )
    made = _enriched(labelled).withColumn("process", F.col("application"))
    reason = F.coalesce(iso_error(F.col("ts_raw")), epoch_error(F.col("ts_raw")))
    # the raw time of such an event is the column of that very name
    return to_event_schema(_or_parse_error(made, reason, None if "timestamp" in names else ingest_ts))


def _promoted(names: list[str]) -> list[Column]:
    """Typed columns that the flow detector reads; text that is no number becomes NULL."""
    types = {"payload_size": "bigint", "src_port": "int", "dst_port": "int"}
    out = [F.col(c).try_cast(t).alias(c) for c, t in types.items() if c in names]
    out += [F.col(c) for c in ("service", "dns_query", "tcp_flags") if c in names]
    return out + ([F.col("dst_ip").alias("dst_ip_raw")] if "dst_ip" in names else [])


def windows_knowledge_base(spark) -> DataFrame:
    """The Windows event ids as a table (fixed size, for a broadcast join)."""
    rows = ", ".join(f"('{i}', '{c}', '{s}', '{d}')" for i, c, s, d in WINDOWS_EVENTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS kb(event_id, category, severity, description)")


def normalize_windows(records: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """Windows event records to events; a time that no calendar holds gives a ``PARSE_ERROR`` event."""
    ingest_ts = F.current_timestamp() if ingest_ts is None else ingest_ts
    data, event_id = F.col("event_data"), F.col("event_id")

    def item(*keys: str) -> Column:
        return first_present(*[F.try_element_at(data, F.lit(k)) for k in keys])

    user, domain = item("TargetUserName", "SubjectUserName", "UserName"), item("TargetDomainName", "SubjectDomainName")
    address, logon = item("IpAddress", "SourceAddress"), item("LogonType")
    process, target = item("ProcessName", "NewProcessName"), item("ObjectName")
    reason, sub_status = item("FailureReason"), item("SubStatus")
    logon_names = F.create_map(*[F.lit(x) for pair in LOGON_TYPES.items() for x in pair])

    def part(label: str, value: Column, when: Column) -> Column:
        return F.when(when, F.concat(F.lit(f"{label}: "), value))

    failed = event_id == "4625"
    known = records.join(F.broadcast(windows_knowledge_base(records.sparkSession)), "event_id", "left")
    events = known.select(
        "event_id",
        windows_timestamp(F.col("ts_raw"), ingest_ts).alias("timestamp"),
        "ts_raw",
        F.concat(F.lit("Windows-"), F.coalesce("channel", F.lit("System"))).alias("source"),
        F.coalesce("category", F.lit("system")).alias("category"),
        F.when(failed & (address != ""), "high")
        .when(event_id.isin("1102", "4719"), "critical")
        .otherwise(F.coalesce("severity", F.lit("info")))
        .alias("severity"),
        F.concat_ws(
            " | ",
            F.coalesce("description", F.concat(F.lit("Windows Event "), event_id)),
            part(
                "User",
                F.when(domain != "", F.concat(domain, F.lit("\\"), user)).otherwise(user),
                user != "",
            ),
            part("Source IP", address, (address != "") & (address != "-")),
            part("Logon Type", F.coalesce(F.try_element_at(logon_names, logon), logon), logon != ""),
            part("Process", process, process != ""),
            part("Reason", reason, failed & (reason != "")),
            part("SubStatus", sub_status, failed & (reason == "") & (sub_status != "")),
            part("Object", target, target != ""),
        ).alias("message"),
        F.map_concat(
            F.create_map(
                *[
                    x
                    for c in ("provider", "computer", "channel", "level", "keywords")
                    for x in (F.lit(c), F.coalesce(c, F.lit("")))
                ],
                F.lit("event_data"),
                F.to_json(data),
                F.lit("user_data"),
                F.to_json("user_data"),
            )
        ).alias("raw_data"),
        "source_file",
        F.when(address != "-", address).otherwise("").alias("source_ip"),
        user.alias("username"),
        F.col("computer").alias("hostname"),
        process.alias("process"),
        F.to_json(data).alias("details"),
        "file_seq",
        "row_no",
    )
    return to_event_schema(_or_parse_error(events, iso_error(F.col("ts_raw"))))


def normalize_packets(packets: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """Packet records to events; a payload size that is no number gives a ``PARSE_ERROR`` event.

    A record without a time gets ``ingest_ts`` where that is given.
    """
    protocol = F.coalesce("protocol", F.lit("UNKNOWN"))
    service = F.coalesce("service", protocol)
    src, dst = F.coalesce("src_ip", F.lit("N/A")), F.coalesce("dst_ip", F.lit("N/A"))
    payload = F.coalesce(F.col("payload_size").try_cast("bigint"), F.lit(0))
    bad = F.col("payload_size").isNotNull() & F.col("payload_size").try_cast("bigint").isNull()
    flags = F.coalesce("tcp_flags", F.lit(""))
    dns = F.coalesce("dns_query", F.lit(""))
    arrow = F.lit(" → ")
    ports = F.concat(
        src, F.lit(":"), F.col("src_port"), arrow, dst, F.lit(":"), F.coalesce(F.col("dst_port").cast("string"), F.lit(""))
    )
    message = F.concat_ws(
        " | ",
        protocol,
        F.when(F.coalesce("src_port", F.lit(0)) != 0, ports).otherwise(F.concat(src, arrow, dst)),
        F.when((service != "") & (service != protocol), F.concat(F.lit("["), service, F.lit("]"))),
        F.when(flags != "", F.concat(F.lit("Flags: "), flags)),
        F.when(payload > 0, F.concat(F.lit("Payload: "), payload, F.lit("B"))),
        F.when(dns != "", F.concat(F.lit("DNS: "), dns)),
    )

    def unless_bad(good: Column, otherwise: Column | str) -> Column:
        return F.when(bad, otherwise if isinstance(otherwise, Column) else F.lit(otherwise)).otherwise(good)

    severity = F.when(F.col("dst_port").isin(*SENSITIVE_PORTS) | (payload > LARGE_PAYLOAD), "medium").otherwise("info")
    raw_fields = [
        c
        for c in ("src_ip", "dst_ip", "ip_version", "ttl", "src_port", "dst_port", "protocol", "tcp_flags", "seq",
                  "ack", "window", "icmp_type", "icmp_code", "service", "dns_query", "payload_size", "packet_size",
                  "error")
        if c in packets.columns
    ]
    raw = F.create_map(*[x for c in raw_fields for x in (F.lit(c), F.col(c).cast("string"))])
    return to_event_schema(
        packets.select(
            F.col("timestamp") if ingest_ts is None else F.coalesce("timestamp", ingest_ts).alias("timestamp"),
            unless_bad(
                F.when(service != "", F.concat(F.lit("network-"), F.lower(service))).otherwise("network"),
                F.col("source_file"),
            ).alias("source"),
            unless_bad(F.coalesce("event_id", F.concat(F.lit("NET_"), protocol)), "PARSE_ERROR").alias("event_id"),
            unless_bad(F.lit("network"), "system").alias("category"),
            unless_bad(severity, "low").alias("severity"),
            unless_bad(message, "Normalization error: payload size is not a number").alias("message"),
            F.map_filter(raw, lambda _, v: v.isNotNull()).alias("raw_data"),
            "source_file",
            unless_bad(src, "").alias("source_ip"),
            unless_bad(dst, "").alias("dest_ip"),
            unless_bad(first_present(service, protocol), "").alias("process"),
            F.concat(
                F.lit("Size: "), F.coalesce(F.col("packet_size").cast("string"), F.lit("0")), F.lit("B")
            ).alias("details"),
            payload.alias("payload_size"),
            F.col("service"),
            F.col("dns_query"),
            F.col("dst_ip").alias("dst_ip_raw"),
            F.col("src_port").try_cast("int").alias("src_port"),
            F.col("dst_port").try_cast("int").alias("dst_port"),
            flags.alias("tcp_flags"),
            "file_seq",
            "row_no",
        )
    )
