"""Syslog lines: scan, line patterns, category, severity hint and event id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.functions.text import contains_sql, strip
from logtrail.functions.times import syslog_timestamp
from logtrail.sources.files import chosen, with_origin

# The line patterns, in the order in which they are tried.
# The groups are timestamp, hostname, process, pid, message; the third pattern has no host and process.
_TAG = r"\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?\s*:\s*(.*)$"
BSD_LINE = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})" + _TAG
ISO_LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:\d{2}|Z)?)" + _TAG
PLAIN_LINE = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)()()()\s+(.*)$"
EPOCH_LINE = r"^(\d{10,13}(?:\.\d+)?)" + _TAG

# Category and severity keywords (substrings, tried in this order).
AUTH_WORDS = (
    "authentication", "login", "logout", "password", "pam_unix", "sshd", "sudo", "failed", "accepted",
    "invalid user", "session opened", "session closed", "publickey", "preauth", "authorized",
    "unauthorized", "credential", "kerberos", "logon", "logoff", "privilege", "su:", "su[",
)
NETWORK_WORDS = (
    "connection", "listening", "port", "firewall", "iptables", "ufw", "denied", "allowed", "interface",
    "dhcp", "dns", "resolved", "tcp", "udp",
)
FILE_WORDS = (
    "file", "open", "read", "write", "delete", "create", "modify", "access", "permission", "chmod",
    "chown", "rename", "move", "copy",
)
WARNING_WORDS = ("error", "fail", "denied", "invalid", "critical")
CRITICAL_WORDS = ("alert", "emergency", "panic", "fatal")

# Synthetic event ids. Each family is (words, where they are sought, outcomes, default id);
# an outcome is (words of the message, id). Families and outcomes are tried in order.
EVENT_ID_FAMILIES = (
    (
        ("ssh",), "process",
        (
            (("accepted",), "SSH_LOGIN_SUCCESS"),
            (("failed", "invalid"), "SSH_LOGIN_FAILED"),
            (("disconnect",), "SSH_DISCONNECT"),
            (("connection closed",), "SSH_CONN_CLOSED"),
        ),
        "SSH_EVENT",
    ),
    (
        ("pam_",), "message",
        (
            (("session opened",), "PAM_SESSION_OPEN"),
            (("session closed",), "PAM_SESSION_CLOSE"),
            (("authentication failure",), "PAM_AUTH_FAIL"),
        ),
        "PAM_EVENT",
    ),
    (
        ("sudo",), "process",
        ((("command",), "SUDO_COMMAND"), (("not allowed", "incorrect password"), "SUDO_DENIED")),
        "SUDO_EVENT",
    ),
    (
        ("systemd",), "process",
        ((("started",), "SERVICE_START"), (("stopped",), "SERVICE_STOP"), (("failed",), "SERVICE_FAIL")),
        "SYSTEMD_EVENT",
    ),
    (("kernel",), "process", ((("firewall", "iptables", "ufw"), "FIREWALL_EVENT"),), "KERNEL_EVENT"),
    (("cron",), "process", (), "CRON_EVENT"),
    (
        ("authentication",), "category",
        ((("failed",), "AUTH_FAILED"), (("success", "accepted"), "AUTH_SUCCESS")),
        "AUTH_EVENT",
    ),
)
OTHER_EVENT_ID = "SYS_EVENT"

_SEP = "\x01"
_GROUPS = _SEP + _SEP.join(f"${i}" for i in range(1, 6))


def _with_fields(stripped: DataFrame) -> DataFrame:
    """Add ``_f``: [_, timestamp, hostname, process, pid, message] of the first pattern that fits, else NULL.

    The replacement rewrites a fitting line with separators. A later pattern is
    tried only where the line is still as it was, and each is evaluated once.
    """
    line = F.col("raw_line")
    tried = stripped.withColumn("_t", F.regexp_replace(line, "(?Ud)" + BSD_LINE, _GROUPS))
    for pattern in (ISO_LINE, PLAIN_LINE, EPOCH_LINE):
        again = F.regexp_replace(line, "(?Ud)" + pattern, _GROUPS)
        tried = tried.withColumn("_t", F.when(F.col("_t") == line, again).otherwise(F.col("_t")))
    return tried.withColumn("_f", F.when(F.col("_t") != line, F.split("_t", _SEP, 6))).drop("_t")


def classify_lines(df: DataFrame) -> DataFrame:
    """Add ``category``, ``severity_hint`` and ``event_id`` from ``message`` and ``process``."""

    def case(branches: list[tuple[str, str]], default: str) -> str:
        whens = " ".join(f"WHEN {condition} THEN {value}" for condition, value in branches)
        return f"CASE {whens} ELSE {default} END" if whens else default

    category = case(
        [
            (contains_sql("_text", AUTH_WORDS), "'authentication'"),
            (contains_sql("_text", NETWORK_WORDS), "'network'"),
            (contains_sql("_text", FILE_WORDS), "'file_access'"),
        ],
        "'system'",
    )
    hint = case(
        [(contains_sql("_message", WARNING_WORDS), "'warning'"), (contains_sql("_message", CRITICAL_WORDS), "'critical'")],
        "'info'",
    )
    families = [
        (
            contains_sql({"message": "_message", "process": "_process"}.get(sought, sought), words),
            case([(contains_sql("_message", w), f"'{event_id}'") for w, event_id in outcomes], f"'{default}'"),
        )
        for words, sought, outcomes, default in EVENT_ID_FAMILIES
    ]
    lowered = df.withColumns({"_message": F.lower("message"), "_process": F.lower("process")})
    return (
        lowered.withColumn("_text", F.concat_ws(" ", "_message", "_process"))
        .withColumns({"category": F.expr(category), "severity_hint": F.expr(hint)})
        .withColumn("event_id", F.expr(case(families, f"'{OTHER_EVENT_ID}'")))
        .drop("_message", "_process", "_text")
    )


def parse_syslog(lines: DataFrame, assumed_year: int, ingest_ts: Column | None = None) -> DataFrame:
    """Parse a frame with a text column ``value``; its other columns pass through.

    BSD lines carry no year, and lines without a usable time get ``ingest_ts``;
    both are parameters so that a rerun gives the same rows.
    """
    ingest_ts = F.current_timestamp() if ingest_ts is None else ingest_ts
    others = [c for c in lines.columns if c != "value"]
    stripped = lines.select(*others, strip(F.make_valid_utf8(F.col("value"))).alias("raw_line")).filter("raw_line <> ''")
    fields = _with_fields(stripped)

    def group(i: int) -> Column:
        return F.coalesce(F.col("_f")[i], F.lit(""))

    parsed = fields.select(
        *others,
        "raw_line",
        group(1).alias("ts_raw"),
        group(2).alias("hostname"),
        group(3).alias("process"),
        group(4).alias("pid"),
        F.coalesce(F.col("_f")[5], F.col("raw_line")).alias("message"),
    )
    return classify_lines(
        parsed.withColumn("timestamp", syslog_timestamp(F.col("ts_raw"), assumed_year, ingest_ts))
    )


def read_syslog(
    spark: SparkSession,
    paths: str | list[str],
    assumed_year: int,
    ingest_ts: Column | None = None,
    file_seq: int = 0,
    identity: str = "file_name",
    keep: Column | None = None,
    **options,
) -> DataFrame:
    """Read and parse syslog files; large files are split across tasks. ``options`` go to the reader.

    ``keep`` is a predicate on ``_metadata`` that chooses among the files.
    """
    lines = chosen(spark.read.options(**options).text(paths), keep)
    return parse_syslog(with_origin(lines, file_seq, identity), assumed_year, ingest_ts)
