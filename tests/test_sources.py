"""Readers on small files written by the tests."""

import struct
import time

import pytest
from pyspark.sql import functions as F

from logtrail.functions.text import last_wins_map
from logtrail.operators.normalize import normalize_csv, normalize_packets, normalize_syslog, normalize_windows
from logtrail.sources.csv import inspect_files, read_csv
from logtrail.sources.packets import read_captures, read_packet_table
from logtrail.sources.router import (
    dedupe_inputs,
    file_counts,
    list_files,
    plan_inputs,
    read_logs,
    supported_extensions,
)
from logtrail.sources.syslog import parse_syslog, read_syslog
from logtrail.sources.winevent import read_windows_events
from workload import QUERIES

def now():
    return F.lit("2026-05-01 00:00:00").cast("timestamp")


def parse(spark, lines):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "row_no long, value string")
    return parse_syslog(df, 2026, now()).orderBy("row_no").collect()


def test_line_patterns(spark):
    rows = parse(
        spark,
        [
            "Apr 10 08:00:00 web-01 sshd[920]: Accepted publickey for ann from 10.0.0.1 port 5 ssh2",
            "2026-04-10T08:00:01Z db-01 postgres: disk ready",
            "2026-04-10 08:00:02 plain text: with colon",
            "1775808003.5 gw kernel: ufw block",
            "   no pattern here \t",
            "",
            " \t ",
        ],
    )
    assert [(r.ts_raw, r.hostname, r.process, r.pid, r.message) for r in rows] == [
        ("Apr 10 08:00:00", "web-01", "sshd", "920", "Accepted publickey for ann from 10.0.0.1 port 5 ssh2"),
        ("2026-04-10T08:00:01Z", "db-01", "postgres", "", "disk ready"),
        ("2026-04-10 08:00:02", "", "", "", "plain text: with colon"),
        ("1775808003.5", "gw", "kernel", "", "ufw block"),
        ("", "", "", "", "no pattern here"),
    ]
    assert [str(r.timestamp) for r in rows] == [
        "2026-04-10 08:00:00",
        "2026-04-10 08:00:01",
        "2026-04-10 08:00:02",
        "2026-04-10 08:00:03.500000",
        "2026-05-01 00:00:00",
    ]


def test_categories_hints_and_event_ids(spark):
    cases = [
        ("sshd", "Accepted password for x", "authentication", "info", "SSH_LOGIN_SUCCESS"),
        ("sshd", "Failed password for x", "authentication", "warning", "SSH_LOGIN_FAILED"),
        ("sshd", "Received disconnect", "authentication", "info", "SSH_DISCONNECT"),
        ("sshd", "Connection closed by x", "authentication", "info", "SSH_CONN_CLOSED"),
        ("sshd", "pam_unix(sshd:session): session opened", "authentication", "info", "SSH_EVENT"),
        ("login", "pam_unix(login): session opened", "authentication", "info", "PAM_SESSION_OPEN"),
        ("login", "pam_x session closed", "authentication", "info", "PAM_SESSION_CLOSE"),
        ("login", "pam_x authentication failure", "authentication", "warning", "PAM_AUTH_FAIL"),
        ("login", "pam_env", "authentication", "info", "PAM_EVENT"),
        ("sudo", "ann : COMMAND=/bin/ls", "authentication", "info", "SUDO_COMMAND"),
        ("sudo", "ann : user not allowed", "authentication", "info", "SUDO_DENIED"),
        ("sudo", "ann", "authentication", "info", "SUDO_EVENT"),
        ("systemd", "Started nginx", "system", "info", "SERVICE_START"),
        ("systemd", "Stopped nginx", "system", "info", "SERVICE_STOP"),
        ("systemd", "unit failed", "authentication", "warning", "SERVICE_FAIL"),
        ("systemd", "reached target", "system", "info", "SYSTEMD_EVENT"),
        ("kernel", "ufw block", "network", "info", "FIREWALL_EVENT"),
        ("kernel", "panic now", "system", "critical", "KERNEL_EVENT"),
        ("cron", "run", "system", "info", "CRON_EVENT"),
        ("app", "login failed", "authentication", "warning", "AUTH_FAILED"),
        ("app", "logon success", "authentication", "info", "AUTH_SUCCESS"),
        ("app", "su[3] ok", "authentication", "info", "AUTH_EVENT"),
        ("app", "daily report", "network", "info", "SYS_EVENT"),  # "port" inside "report"
        ("app", "file opened", "file_access", "info", "SYS_EVENT"),
    ]
    rows = parse(spark, [f"Apr 10 08:00:00 h {p}[1]: {m}" for p, m, *_ in cases])
    assert [(r.category, r.severity_hint, r.event_id) for r in rows] == [tuple(c[2:]) for c in cases]


def test_syslog_events(spark):
    lines = ["Apr 10 08:00:00 h sshd[1]: Failed password for invalid user bob from 10.0.0.9 port 2222 ssh2"]
    df = spark.createDataFrame([(0, 0, "a.log", x) for x in lines], "row_no long, file_seq int, source_file string, value string")
    r = normalize_syslog(parse_syslog(df, 2026, now())).first()
    assert r.message == "[sshd] Failed password for invalid user bob from 10.0.0.9 port 2222 ssh2"
    assert (r.source, r.source_ip, r.username, r.severity) == ("a.log", "10.0.0.9", "bob", "warning")
    assert (r.details, r.process, r.raw_data["pid"]) == ("App: Unknown Application | Port: 2222", "sshd", "1")
    assert "raw_line" not in r.raw_data


def test_text_files_keep_their_row_order(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"Apr 10 08:00:00 h app: line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_syslog(spark, str(path), 2026, now())
        assert df.rdd.getNumPartitions() > 1
        rows = df.select("row_no", "message").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # Splits below 1 MiB share a block number, so only the order inside a split is checked here.
    assert sorted(int(r.message.split()[1]) for r in rows) == list(range(5000))


def test_csv_delimiters_headers_and_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Event ID, Time ,Message\n1,2026-04-10T08:00:00Z,"a, b\nc"\n2,,\n3,2026-04-10T08:00:01Z, x ,surplus\n')
    (tmp_path / "b.csv").write_text("id;msg;source_file\n7;one, two;f\n8;three\n")
    (tmp_path / "c.csv").write_text("only\nvalue\n")
    found = {r.file_path.rsplit("/", 1)[1]: r.delimiter for r in inspect_files(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": ",", "b.csv": ";", "c.csv": ","}
    frames = {tuple(f.columns[:-3]): f.orderBy("row_no").collect() for f in read_csv(spark, str(tmp_path))}
    a = frames[("event_id", "time", "message")]
    assert [(r.event_id, r.time, r.message) for r in a] == [
        ("1", "2026-04-10T08:00:00Z", "a, b\nc"),
        ("2", "", ""),
        ("3", "2026-04-10T08:00:01Z", "x"),
    ]
    assert a[0].source_file == "a.csv"
    assert [(r.id, r.msg, r.source_file_) for r in frames[("id", "msg", "source_file_")]] == [("7", "one, two", "f"), ("8", "three", "")]


def test_csv_headers_of_files_that_share_a_task(spark, tmp_path):
    for name, sep in (("a", ","), ("b", ";"), ("c", ","), ("d", ";")):
        rows = "".join(f'{k}{sep}"cell {k}\nof {name}"\n' for k in range(4 + ord(name) - ord("a")))
        (tmp_path / f"{name}.csv").write_text(f"Id{sep}Text\n{rows}")
    settings = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = [(r.source_file, r.id, r.text) for f in read_csv(spark, str(tmp_path)) for r in f.collect()]
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert sorted(found) == sorted((f"{n}.csv", str(k), f"cell {k}\nof {n}") for n in "abcd" for k in range(4 + ord(n) - ord("a")))


def test_csv_scan_of_nulls_and_other_types(spark, tmp_path):
    rows = [(1, 7, "error", "p"), (2, None, "click", None), (None, 3, "signup", "q"), (4, 5, None, "r"), (5, 6, "audit", "s"), (6, 7, "view", "t")]
    table = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string")
    table.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    found = [tuple(r) for r in QUERIES["csv_scan"](spark, str(tmp_path)).collect()]
    cell = 'a "quoted" cell; \nsecond line'
    assert sorted(found, key=str) == sorted([r[:3] + (cell if r[2] == "view" else r[3],) for r in rows], key=str)


def test_maps_compare_entries_only_where_a_key_repeats(spark):
    entry = "array<struct<key:string,value:string>>"
    rows = [([("a", "1"), ("b", "2")],), ([("a", "1"), ("b", "2"), ("a", "3")],), ([],), (None,)]
    df = spark.createDataFrame(rows, f"e {entry}").select(last_wins_map(F.col("e")).alias("m"))
    assert [r.m for r in df.collect()] == [{"a": "1", "b": "2"}, {"b": "2", "a": "3"}, {}, None]
    many = F.transform(F.sequence(F.lit(1), F.col("id") % 2 + 8000), lambda k: F.struct(k.cast("string").alias("key"), k.cast("string").alias("value")))
    wide = spark.range(8).select(F.size(last_wins_map(many)).alias("n"))
    begun = time.perf_counter()
    assert {r.n for r in wide.collect()} == {8000, 8001}
    assert time.perf_counter() - begun < 10


def test_event_xml_is_split_once(spark, tmp_path, capsys):
    (tmp_path / "a.xml").write_text("<Events>\n<Event><System><EventID>4625</EventID></System></Event>\n</Events>\n")
    read = read_windows_events(spark, str(tmp_path))
    assert [r.event_id for r in read.collect()] == ["4625"]
    capsys.readouterr()
    read.explain()
    assert capsys.readouterr().out.count("split(") == 1


def test_csv_events(spark):
    columns = "date string, code string, type string, level string, src string, user string, note string, extra string, more string"
    rows = [
        ("2026-04-10 08:00:00", "X1", "Net flow", "WARN", "10.0.0.1", "ann", "n", "e", "m"),
        ("", "", "", "", "", "", "", "", ""),
        ("bad", "X3", "Custom", "meh", "", "", "", "via App Foo 10.9.9.9", ""),
    ]
    df = spark.createDataFrame(rows, columns).withColumns(
        {"source_file": F.lit("s.csv"), "file_seq": F.lit(0), "row_no": F.monotonically_increasing_id()}
    )
    a, b, c = normalize_csv(df, now()).orderBy("row_no").collect()
    assert (a.event_id, a.category, a.severity, a.source_ip, a.username) == ("X1", "network", "medium", "10.0.0.1", "ann")
    assert a.message == "type=Net flow | level=WARN | src=10.0.0.1 | user=ann | note=n"
    assert (b.event_id, b.message, b.category, b.severity, b.process) == ("CSV_EVENT", "", "system", "info", "Unknown Application")
    assert str(b.timestamp) == str(c.timestamp) == "2026-05-01 00:00:00"
    assert (c.category, c.severity, c.source_ip, c.process, c.hostname) == ("custom", "info", "10.9.9.9", "Foo", "")


def test_csv_payload_that_is_no_number(spark):
    df = spark.createDataFrame([("12", "f", 0, 0), ("x", "f", 0, 1)], "payload_size string, source_file string, file_seq int, row_no long")
    assert [r.payload_size for r in normalize_csv(df, now()).orderBy("row_no").collect()] == [12, None]


WINDOWS_XML = """<Events>
<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="P"/><EventID Qualifiers="0">4625</EventID>
<Level>0</Level><TimeCreated SystemTime="2026-04-10T08:00:00.5Z"/><Channel>Security</Channel><Computer>WS1</Computer></System>
<EventData><Data Name="TargetUserName">ann</Data><Data Name="TargetDomainName">CORP</Data><Data Name="IpAddress">10.0.0.7</Data>
<Data Name="LogonType">3</Data><Data Name="FailureReason">bad password</Data><Data>loose</Data><Data Name="TargetUserName">bob</Data></EventData></Event>
<Event><System><EventID>1102</EventID><TimeCreated SystemTime="soon"/><Channel>Security</Channel><Computer>WS2</Computer></System>
<UserData><LogFileCleared><SubjectUserName>eve &amp; co</SubjectUserName><Reason> full </Reason></LogFileCleared></UserData></Event>
</Events>"""


def test_windows_events(spark, tmp_path):
    (tmp_path / "sec.xml").write_text(WINDOWS_XML)
    records = read_windows_events(spark, str(tmp_path))
    first, second = records.orderBy("row_no").collect()
    assert first.event_data["TargetUserName"] == "bob" and first.event_data["field_5"] == "loose"
    assert second.user_data == {"SubjectUserName": "eve & co", "Reason": "full"}
    a, b = normalize_windows(records, now()).orderBy("row_no").collect()
    assert a.message == (
        "Failed logon attempt | User: CORP\\bob | Source IP: 10.0.0.7 | Logon Type: Network | Reason: bad password"
    )
    assert (a.source, a.severity, a.source_ip, a.username, a.hostname) == ("Windows-Security", "high", "10.0.0.7", "bob", "WS1")
    assert (b.severity, b.category, b.message, b.timestamp, b.ts_raw) == ("critical", "system", "Audit log cleared", None, "soon")


def _frame(protocol, src, dst, sport, dport, payload=b"", flags=0x02):
    if protocol == 6:
        body = struct.pack(">HHIIHHHH", sport, dport, 1, 2, (5 << 12) | flags, 64, 0, 0) + payload
    elif protocol == 17:
        body = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    else:
        body = bytes([8, 0, 0, 0, 0, 0, 0, 0]) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, protocol, 0, bytes(src), bytes(dst)) + body
    return b"\0" * 12 + b"\x08\x00" + ip


def capture(frames):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack("<IIII", 1775808000 + i, 250000, len(f), len(f)) + f
    return out


def test_capture_files(spark, tmp_path):
    dns = struct.pack(">HHHHHH", 1, 0, 1, 0, 0, 0) + b"\x03www\x07example\x00" + b"\0\1\0\1"
    frames = [
        _frame(6, (10, 0, 0, 1), (8, 8, 8, 8), 50000, 443, b"x" * 30),
        _frame(17, (10, 0, 0, 1), (8, 8, 4, 4), 50001, 53, dns),
        _frame(1, (10, 0, 0, 1), (8, 8, 8, 8), 0, 0),
        b"\0" * 12 + b"\x08\x06" + b"\0" * 28,
        b"\0" * 12 + b"\x08\x00" + b"\x45\0",
    ]
    (tmp_path / "t.pcap").write_bytes(capture(frames))
    (tmp_path / "bad.pcap").write_bytes(b"nonsense")
    rows = read_captures(spark, str(tmp_path / "t.pcap")).orderBy("row_no").collect()
    assert [(r.protocol, r.service, r.event_id, r.payload_size, r.dns_query) for r in rows] == [
        ("TCP", "HTTPS", "NET_SYN_TCP", 30, None),
        ("UDP", "DNS", "NET_UDP", 0, "www.example."),
        ("ICMP", "ICMP", "NET_ICMP", 0, None),
        ("ARP", None, "NET_ARP", 0, None),
        (None, None, "pcap_parse_error", 0, None),
    ]
    assert str(rows[1].timestamp) == "2026-04-10 08:00:01.250000" and rows[0].packet_size == len(frames[0])
    events = normalize_packets(read_captures(spark, str(tmp_path))).orderBy("source_file", "row_no").collect()
    assert len(events) == 6 and events[0].event_id == "pcap_parse_error"
    assert events[1].message == "TCP | 10.0.0.1:50000 → 8.8.8.8:443 | [HTTPS] | Flags: S | Payload: 30B"
    assert events[2].message == "UDP | 10.0.0.1:50001 → 8.8.4.4:53 | [DNS] | DNS: www.example."
    assert events[3].message == "ICMP | 10.0.0.1 → 8.8.8.8"
    assert (events[1].source, events[1].process, events[1].details) == ("network-https", "HTTPS", f"Size: {len(frames[0])}B")


def test_packet_table(spark, tmp_path):
    spark.createDataFrame(
        [("2026-04-10T08:00:00Z", "10.0.0.1", "8.8.8.8", "TCP", 5000, 3389, 20000)],
        "timestamp string, src_ip string, dst_ip string, protocol string, src_port int, dst_port int, payload_size long",
    ).write.json(str(tmp_path / "p"))
    r = normalize_packets(read_packet_table(spark, str(tmp_path / "p"), "json")).first()
    assert (r.severity, r.service, r.category, r.dest_ip) == ("medium", "RDP", "network", "8.8.8.8")


def test_routing_and_reading_a_mixed_folder(spark, tmp_path):
    (tmp_path / "a.LOG").write_text("Apr 10 08:00:00 h app: one\nApr 10 08:00:01 h app: two\n")
    (tmp_path / "b.csv").write_text("time,message\n2026-04-10T08:00:02Z,three\n")
    (tmp_path / "c.xml").write_text(WINDOWS_XML)
    (tmp_path / "d.exe").write_bytes(b"x")
    (tmp_path / "e.evtx").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv").write_text("time,message\n2026-04-10T08:00:02Z,three\n")  # same name and size
    files = list_files(spark, str(tmp_path))
    accepted, rejected = plan_inputs(dedupe_inputs(files))
    assert sorted(r.name for r in accepted.collect()) == ["a.LOG", "b.csv", "c.xml"]
    reasons = {r.name: r.reason for r in rejected.collect()}
    assert reasons["d.exe"].startswith("Unsupported file type: '.exe'. Supported types: .csv")
    assert "export the events as XML" in reasons["e.evtx"]
    inputs = read_logs(spark, str(tmp_path), 2026, now())
    assert inputs.rejected.count() == 2 and not inputs.failed
    counts = {r.source_file: r.records for r in file_counts(inputs.union()).collect()}
    assert counts == {"a.LOG": 2, "b.csv": 2, "c.xml": 2}
    once = read_logs(spark, str(tmp_path), 2026, now(), skip_same_name_and_size=True)
    assert {r.source_file: r.records for r in file_counts(once.union()).collect()} == {"a.LOG": 2, "b.csv": 1, "c.xml": 2}
    assert [r.reason for r in once.rejected.collect() if r.path.endswith("sub/b.csv")] == ["Same name and size as another file"]
    with pytest.raises(ValueError):
        read_logs(spark, str(tmp_path / "d.exe"), 2026, now())
    assert ".csv" in [r.extension for r in supported_extensions(spark).collect()]


def test_equal_names_stay_apart_and_arguments_keep_their_order(spark, tmp_path):
    line = "Apr 10 08:00:00 h app: host %d\n"
    for k in range(300):
        (tmp_path / f"h{k:03d}").mkdir()
        (tmp_path / f"h{k:03d}" / "auth.log").write_text(line % (100 + k))
    folders = [str(tmp_path / f"h{k:03d}") for k in reversed(range(300))]
    events = read_logs(spark, folders, 2026, now()).union()
    rows = events.orderBy("timestamp", "file_seq", "source_file", "row_no").collect()
    assert [r.message for r in rows] == [f"[app] host {100 + k}" for k in reversed(range(300))]
    assert {r.source_file for r in rows} == {"auth.log"} and len({r.file_seq for r in rows}) == 300
    tree = read_logs(spark, str(tmp_path), 2026, now()).union().orderBy("timestamp", "file_seq").collect()
    assert [r.message for r in tree] == [f"[app] host {100 + k}" for k in range(300)]
