from pyspark.sql import functions as F

from logtrail.functions.messages import (
    application_name,
    details_text,
    first_ipv4,
    first_port,
    message_username,
    threat_severity,
)
from logtrail.functions.network import is_private_ip, packet_event_id, service_name


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, m string")
    return [r.v for r in df.select("i", fn(F.col("m")).alias("v")).orderBy("i").collect()]


def test_application_names(spark):
    texts = [
        "logon via App Outlook-365 ok",
        "Application: billing failed",
        "mapping service",  # "App" inside a word counts
        "Jan 1 host cron[77]: run",
        "nothing to see",
    ]
    assert values(spark, texts, application_name) == ["Outlook-365", "billing", "ing", "cron", "Unknown Application"]
    labelled = values(spark, texts[-1:], lambda m: application_name(m, F.lit("db_mysql")))
    assert labelled == ["MySQL Database"]


def test_addresses_and_ports(spark):
    assert values(spark, ["a 10.0.0.1 b 10.0.0.2", "v1.2.3", ""], first_ipv4) == ["10.0.0.1", "", ""]
    texts = ["port 22 and port 23", "http://h:8080/", "port 70000 then :80", "at 09:23:07", "Port  443", "no"]
    assert values(spark, texts, first_port) == ["22", "8080", "", "23", "443", ""]


def test_users(spark):
    texts = [
        "Failed password for invalid user root from 1.2.3.4",
        "Accepted publickey for deploy from 1.2.3.4",
        "session opened for user ann(uid=1)",
        "User=bob logged in",
        "nobody",
    ]
    assert values(spark, texts, message_username) == ["root", "deploy", "ann(uid=1)", "bob", ""]


def test_details_and_threat_severity(spark):
    row = (
        spark.range(1)
        .select(
            details_text(F.lit("web"), F.lit("80"), F.lit("xss")).alias("full"),
            details_text(F.lit("web"), F.lit(""), F.lit("benign")).alias("short"),
            threat_severity(F.lit("sql_injection"), F.lit("info")).alias("critical"),
            threat_severity(F.lit("xss"), F.lit("info")).alias("high"),
            threat_severity(F.lit("benign"), F.lit("info")).alias("kept"),
        )
        .first()
    )
    assert tuple(row) == ("App: web | Port: 80 | AI THREAT: XSS", "App: web", "critical", "high", "info")


def test_private_addresses(spark):
    private = ["10.1.2.3", "172.16.0.1", "172.31.9.9", "192.168.0.4", "127.8.0.1", "::1", "", "N/A", "-", "0.0.0.0",
               "fe80::1", "1.2.3", "x.1.2.3", "1.x.2.3", None]
    public = ["8.8.8.8", "172.15.0.1", "172.32.0.1", "192.169.0.1", "11.0.0.1", "8.8.x.x"]
    df = spark.createDataFrame([(a,) for a in private + public], "ip string")
    got = {r.ip: r.p for r in df.select("ip", is_private_ip("ip").alias("p")).collect()}
    assert [got[a] for a in private] == [True] * len(private)
    assert [got[a] for a in public] == [False] * len(public)


def test_services_and_packet_ids(spark):
    rows = [
        ("TCP", 51000, 443, "S", "HTTPS", "NET_SYN_TCP"),
        ("TCP", 80, 51000, "SA", "HTTP", "NET_SYNACK_TCP"),
        ("TCP", 51000, 50000, "FA", "TCP/50000", "NET_FIN_TCP"),
        ("TCP", 22, 51000, "R", "SSH", "NET_RST_TCP"),
        ("UDP", 53, 51000, None, "DNS", "NET_UDP"),
        ("UDP", 51000, 4000, None, "UDP/4000", "NET_UDP"),
        ("ICMP", None, None, None, "ICMP", "NET_ICMP"),
        (None, None, None, None, None, "NET_UNKNOWN"),
    ]
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "i int, p string, s int, d int, f string, service string, id string"
    )
    got = df.select(
        "i",
        "service",
        "id",
        service_name(F.col("p"), F.col("s"), F.col("d")).alias("a"),
        packet_event_id(F.col("p"), F.col("f")).alias("b"),
    )
    for r in got.collect():
        assert (r.a, r.b) == (r.service, r.id), r
