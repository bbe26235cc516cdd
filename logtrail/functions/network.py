"""Addresses, ports, services and packet event ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtrail.functions.text import contains_any

# Placeholders that count as private, and well-known ports in order of precedence.
PRIVATE_PLACEHOLDERS = ("", "N/A", "-", "::1", "127.0.0.1", "0.0.0.0")
TCP_SERVICES = (
    ((80, 8080), "HTTP"),
    ((443,), "HTTPS"),
    ((22,), "SSH"),
    ((21,), "FTP"),
    ((25, 587), "SMTP"),
    ((53,), "DNS"),
    ((3389,), "RDP"),
    ((445,), "SMB"),
)
UDP_SERVICES = (((53,), "DNS"), ((67, 68), "DHCP"), ((123,), "NTP"))


_PLACEHOLDERS_SQL = ", ".join(f"'{p}'" for p in PRIVATE_PLACEHOLDERS)
_PUBLIC_SQL = """
    {ip} NOT IN ({placeholders}) AND size(split({ip}, '[.]', -1)) = 4
    AND try_cast(trim(split({ip}, '[.]', -1)[0]) AS INT) NOT IN (10, 127)
    AND NOT (try_cast(trim(split({ip}, '[.]', -1)[0]) AS INT) = 172
        AND try_cast(trim(try_element_at(split({ip}, '[.]', -1), 2)) AS INT) BETWEEN 16 AND 31)
    AND NOT (try_cast(trim(split({ip}, '[.]', -1)[0]) AS INT) = 192
        AND try_cast(trim(try_element_at(split({ip}, '[.]', -1), 2)) AS INT) = 168)
    AND try_cast(trim(try_element_at(split({ip}, '[.]', -1), 2)) AS INT) IS NOT NULL"""


def is_private_ip(ip: str) -> Column:
    """True for column ``ip`` in RFC 1918, loopback, a placeholder, or no dotted quad at all.

    Only the first two octets are read as numbers.
    """
    return ~F.coalesce(F.expr(_PUBLIC_SQL.format(ip=f"`{ip}`", placeholders=_PLACEHOLDERS_SQL)), F.lit(False))


def _service(table: tuple, prefix: str, src_port: Column, dst_port: Column) -> Column:
    expr = None
    for ports, name in table:
        hit = src_port.isin(*ports) | dst_port.isin(*ports)
        expr = F.when(hit, F.lit(name)) if expr is None else expr.when(hit, F.lit(name))
    return expr.otherwise(F.concat(F.lit(f"{prefix}/"), F.least(src_port, dst_port).cast("string")))


def service_name(protocol: Column, src_port: Column, dst_port: Column) -> Column:
    """Service of a packet from its protocol and either port."""
    return (
        F.when(protocol == "TCP", _service(TCP_SERVICES, "TCP", src_port, dst_port))
        .when(protocol == "UDP", _service(UDP_SERVICES, "UDP", src_port, dst_port))
        .when(protocol == "ICMP", F.lit("ICMP"))
    )


def packet_event_id(protocol: Column, tcp_flags: Column) -> Column:
    """Synthetic event id from the TCP flags."""
    flags = F.coalesce(tcp_flags, F.lit(""))
    name = F.coalesce(protocol, F.lit("UNKNOWN"))
    syn, ack = contains_any(flags, "S"), contains_any(flags, "A")
    kind = (
        F.when(syn & ~ack, F.lit("NET_SYN_"))
        .when(syn & ack, F.lit("NET_SYNACK_"))
        .when(contains_any(flags, "F"), F.lit("NET_FIN_"))
        .when(contains_any(flags, "R"), F.lit("NET_RST_"))
        .otherwise(F.lit("NET_"))
    )
    return F.concat(kind, name)
