"""What a log message tells by itself: application, address, port and user."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtrail.functions.text import present

# Display names of the text model's source labels, and the message patterns.
APPLICATION_NAMES = {
    "nginx_access": "Nginx Web Server",
    "apache_error": "Apache HTTP Server",
    "linux_auth": "Linux SSH/Auth (sshd)",
    "windows_security": "Windows Active Directory",
    "db_mysql": "MySQL Database",
    "db_postgres": "PostgreSQL Database",
    "application": "Custom Application",
    "unknown": "Unknown Application",
}
NAMED_APP = r"(?i)(?:via App|Application:?|App:?)\s*([A-Za-z0-9_\-]+)"
TAGGED_APP = r"\s([a-zA-Z0-9_\-]+)\[\d+\]:"
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
PORT = r"(?i)(?:port\s+|:)([1-9][0-9]{0,4})\b"
_PORT_LIMIT = 65536
USER_AFTER_USER = r"(?i)user[= ]+(\S+)"
USER_AFTER_FOR = r"for (?:invalid user )?(\S+)"

# Threats that make an event critical; other threats make it high.
CRITICAL_THREATS = ("sql_injection", "command_injection")


def application_name(message: Column, source_label: Column | None = None) -> Column:
    """Application named in the message, else the name of the source label."""
    fallback = F.lit(APPLICATION_NAMES["unknown"])
    if source_label is not None:
        names = F.create_map(*[F.lit(x) for pair in APPLICATION_NAMES.items() for x in pair])
        fallback = F.coalesce(F.try_element_at(names, source_label), fallback)
    return F.coalesce(
        present(F.regexp_extract(message, NAMED_APP, 1)),
        present(F.regexp_extract(message, TAGGED_APP, 1)),
        fallback,
    )


def first_ipv4(message: Column) -> Column:
    """First dotted quad in the message, or ''."""
    return F.regexp_extract(message, IPV4, 0)


def first_port(message: Column) -> Column:
    """First port in the message; '' when there is none or it is beyond 65535."""
    # The pattern starts with 1-9, so only the upper end needs a check; each step reads the match once.
    # Empty text is made NULL before the cast, which is slow on text that is no number.
    number = present(F.regexp_extract(message, PORT, 1)).try_cast("int")
    port = F.nullif(F.least(number, F.lit(_PORT_LIMIT)), F.lit(_PORT_LIMIT))
    return F.coalesce(port.cast("string"), F.lit(""))


def message_username(message: Column) -> Column:
    """User named in a message: after ``user``, else after ``for``."""
    return F.coalesce(
        present(F.regexp_extract(message, USER_AFTER_USER, 1)),
        present(F.regexp_extract(message, USER_AFTER_FOR, 1)),
        F.lit(""),
    )


def details_text(application: Column, port: Column, threat: Column) -> Column:
    return F.concat(
        F.lit("App: "),
        application,
        F.when(port != "", F.concat(F.lit(" | Port: "), port)).otherwise(F.lit("")),
        F.when(threat != "benign", F.concat(F.lit(" | AI THREAT: "), F.upper(threat))).otherwise(F.lit("")),
    )


def threat_severity(threat: Column, severity: Column) -> Column:
    """A threat label overrides the severity."""
    return (
        F.when(threat.isin(*CRITICAL_THREATS), F.lit("critical"))
        .when(threat != "benign", F.lit("high"))
        .otherwise(severity)
    )
