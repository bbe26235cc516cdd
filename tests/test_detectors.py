"""Detectors on small timelines, several against plain loops."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logtrail.operators.annotate import annotate
from logtrail.operators.brute_force import detect_brute_force, followed_by_success
from logtrail.operators.exfiltration import detect_exfiltration
from logtrail.operators.file_access import detect_file_access
from logtrail.operators.new_source import detect_new_source
from logtrail.operators.ordering import build_timeline
from logtrail.operators.privilege import account_burst, detect_privilege_escalation, escalations
from logtrail.operators.threat import detect_threats
from logtrail.plans.correlate import DetectionConfig, correlate
from logtrail.schema import to_event_schema

BASE = datetime(2026, 4, 10, 8, tzinfo=timezone.utc)


def timeline(spark, rows):
    """Events from dicts with ``at`` in seconds after the start; the list order is the index."""
    names = ("event_id", "category", "severity", "message", "source_ip", "dest_ip", "username", "process", "hostname",
             "service", "dns_query", "threat_type", "source_file")
    data = [
        (i, None if r.get("at") is None else BASE + timedelta(seconds=r["at"]), r.get("payload_size"),
         *[r.get(n, "benign" if n == "threat_type" else "") for n in names])
        for i, r in enumerate(rows)
    ]
    schema = "event_idx long, timestamp timestamp, payload_size long, " + ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame(data, schema)
    return to_event_schema(df.withColumn("row_no", F.col("event_idx"))).withColumn("event_idx", F.col("row_no"))


def failed(at, **kw):
    return {"at": at, "event_id": "4625", "category": "authentication", "severity": "high", "message": "bad", **kw}


def members_of(detection):
    out = {}
    for r in detection.members.collect():
        out.setdefault(r.alert_id, []).append(r.event_idx)
    return {k: sorted(v) for k, v in out.items()}


def test_brute_force_alert(spark):
    rows = [failed(i * 10, source_ip="1.1.1.1", username="ann") for i in range(7)]
    rows.append({"at": 400, "event_id": "4624", "source_ip": "1.1.1.1"})
    rows += [failed(2000 + i * 100, source_ip="2.2.2.2") for i in range(4)]
    rows.append({"at": 3000, "event_id": "x", "category": "authentication", "message": "Login FAILURE", "source_ip": "2.2.2.2"})
    found = detect_brute_force(timeline(spark, rows))
    (a,) = found.alerts.collect()
    assert (a.severity, a.event_count, a.target, a.source_ip) == ("critical", 7, "ann", "1.1.1.1")
    assert a.description == (
        "Detected 7 failed authentication attempts from 1.1.1.1 within 300s"
        " — FOLLOWED BY SUCCESSFUL LOGIN (possible compromise) targeting user 'ann'"
    )
    assert a.confidence == pytest.approx(0.7) and len(a.evidence) == 7
    assert a.evidence[1] == "2026-04-10T08:00:10+00:00 - 4625: bad"
    assert members_of(found) == {a.alert_id: list(range(7))}


def test_brute_force_entities(spark):
    rows = [failed(i, source_ip=f"1.1.1.{i % 2}", username="ann", process=f"p{i % 3}") for i in range(12)]
    df = timeline(spark, rows)
    counts = {e: detect_brute_force(df, 300, 4, e).alerts.count() for e in ("process", "ip", "user")}
    assert counts == {"process": 3, "ip": 2, "user": 1}
    placeholders = timeline(spark, [failed(i, source_ip="-") for i in range(6)] + [failed(9 + i) for i in range(6)])
    assert detect_brute_force(placeholders).alerts.count() == 0


@pytest.mark.parametrize("after_only", [False, True])
def test_success_nearby_equals_a_loop(spark, after_only):
    rng = random.Random(4)
    rows = [{"at": t, "event_id": "4624", "source_ip": f"ip{rng.randrange(4)}"} for t in sorted(rng.sample(range(20000), 60))]
    events = timeline(spark, rows)
    ends = [(f"ip{rng.randrange(5)}", i, int(BASE.timestamp() * 1e6) + rng.randrange(20000) * 1_000_000) for i in range(80)]
    windows = spark.createDataFrame(ends, "key string, start long, last_t long")
    got = {(r.key, r.start) for r in followed_by_success(windows, events, after_only=after_only).collect()}
    expected = set()
    for key, start, last in ends:
        for r in rows:
            gap = r["at"] - (last / 1e6 - BASE.timestamp())
            if r["source_ip"] == key and abs(gap) <= 600 and (gap >= 0 or not after_only):
                expected.add((key, start))
    assert got == expected


def test_rare_privileged_sources(spark):
    rows = [{"at": i, "event_id": "1", "process": "busy", "severity": "high"} for i in range(60)]
    rows += [{"at": 100 + i, "event_id": "4672" if i else "1", "process": "rare", "hostname": "h", "message": "m"} for i in range(3)]
    rows += [{"at": 200, "event_id": "1", "process": "quiet"}, {"at": 201, "event_id": "4672", "source_ip": "127.0.0.1"}]
    found = detect_new_source(timeline(spark, rows))
    (a,) = found.alerts.collect()
    assert a.title == "Suspicious New IP: rare" and a.target == "h" and a.event_count == 2
    assert a.confidence == pytest.approx(0.9) and members_of(found) == {a.alert_id: [61, 62]}
    assert str(a.timestamp) == "2026-04-10 08:01:40" and a.end_timestamp is None


@pytest.mark.parametrize("lookahead", [199, 6, None])
def test_escalations_equal_a_loop(spark, lookahead):
    rng = random.Random(11)
    ids = ["4625", "4625", "4624", "4672", "9"]
    rows = [{"at": i * 7, "event_id": rng.choice(ids), "source_ip": f"ip{rng.randrange(3)}"} for i in range(250)]
    got = escalations(timeline(spark, rows), 60, lookahead, segment_rows=17).collect()
    expected = set()
    for i, r in enumerate(rows):
        if r["event_id"] != "4625":
            continue
        success = privilege = None
        for j in range(i + 1, min(len(rows), i + 1 + (lookahead or len(rows)))):
            if rows[j]["at"] - r["at"] > 60:
                break
            if rows[j]["source_ip"] == r["source_ip"]:
                if rows[j]["event_id"] == "4624" and success is None:
                    success = j
                if rows[j]["event_id"] == "4672" and privilege is None:
                    privilege = j
        if success is not None and privilege is not None:
            expected.add((i, success, privilege))
    assert {(r.event_idx, r.success.event_idx, r.privilege.event_idx) for r in got} == expected and expected


def test_account_burst(spark):
    rows = [{"at": t, "event_id": "4720", "message": "made"} for t in (0, 400, 900, 1000, 1100, 1150, 1900)]
    df = timeline(spark, rows)
    assert sorted(r.event_idx for r in account_burst(df, block_rows=2).collect()) == []
    rows = [{"at": t, "event_id": "4720", "message": "made"} for t in (0, 400, 900, 950, 960)]
    found = detect_privilege_escalation(timeline(spark, rows))
    (a,) = found.alerts.collect()
    assert (a.title, a.event_count) == ("Rapid Account Manipulation", 3)
    assert a.description == "Detected 3 account management operations within 60s."
    assert members_of(found) == {a.alert_id: [2, 3, 4]}
    assert detect_privilege_escalation(timeline(spark, rows[:2])).alerts.count() == 0


@pytest.mark.parametrize("block_rows", [2, 3, 1000])
def test_account_burst_equals_a_loop(spark, block_rows):
    rng = random.Random(3)
    for _ in range(3):
        times, t = [], 0
        for _ in range(30):
            t += rng.choice([20, 60, 110, 200])
            times.append(t)
        df = timeline(spark, [{"at": x, "event_id": rng.choice(["4720", "4732"])} for x in times])
        expected = []
        for i in range(len(times) - 2):
            run = times[i : i + 5]
            if run[-1] - run[0] <= 300:
                expected = list(range(i, i + len(run)))
                break
        assert sorted(r.event_idx for r in account_burst(df, block_rows=block_rows).collect()) == expected


def test_file_bursts_and_ransomware(spark):
    rows = [{"at": i, "event_id": "4663", "source_ip": "a"} for i in range(12)]
    rows += [{"at": 500 + i, "event_id": "4660" if i < 4 else "4656", "source_ip": "b"} for i in range(10)]
    rows += [{"at": 900 + i, "event_id": "x", "message": "Modify it", "username": "c"} for i in range(10)]
    found = detect_file_access(timeline(spark, rows))
    got = {r.target: r for r in found.alerts.collect()}
    assert {k: (r.severity, r.mitre_technique, r.event_count) for k, r in got.items()} == {
        "a": ("high", "T1005", 12),
        "b": ("critical", "T1486", 10),
        "c": ("high", "T1005", 10),
    }
    assert got["a"].confidence == pytest.approx(0.7) and len(got["a"].evidence) == 10
    assert got["b"].title == "Possible Ransomware Activity" and got["b"].mitre_tactic == "Impact"


def net(at, src="10.0.0.1", dst="8.8.8.8", **kw):
    return {"at": at, "event_id": "NET_TCP", "category": "network", "source_ip": src, "dest_ip": dst, "message": "m", **kw}


def test_exfiltration_reasons(spark):
    rows = [net(i, payload_size=30_000, process="HTTPS") for i in range(2)]
    rows += [net(10 + i, dst="8.8.4.4") for i in range(50)]
    rows += [net(100 + i * 40, dst="9.9.9.9", dns_query=f"h{i % 15}.example") for i in range(20)]
    rows += [net(5, src="8.8.8.8", dst="10.0.0.1", payload_size=90_000), net(6, dst="10.0.0.2", payload_size=90_000)]
    found = detect_exfiltration(timeline(spark, rows))
    got = {r.target: r for r in found.alerts.collect()}
    assert set(got) == {"8.8.8.8", "8.8.4.4", "9.9.9.9"}
    prefix = "Suspicious outbound traffic from 10.0.0.1 → "
    assert got["8.8.8.8"].description == prefix + "8.8.8.8: Large data transfer: 60,000 bytes"
    assert got["8.8.4.4"].description == prefix + "8.8.4.4: High packet volume: 50 packets in 49s"
    assert got["9.9.9.9"].description == prefix + "9.9.9.9: Possible DNS tunneling: 15 unique DNS queries"
    assert (got["8.8.8.8"].process, got["8.8.4.4"].process) == ("HTTPS", "")
    assert len(members_of(found)[got["8.8.4.4"].alert_id]) == 50


def test_threats_and_annotation(spark):
    rows = [
        {"at": 0, "event_id": "W", "threat_type": "sql_injection", "message": "q", "process": "web"},
        {"at": 1, "event_id": "W", "threat_type": "odd_thing", "message": "r", "hostname": "h"},
        {"at": 2, "event_id": "W", "message": "s"},
    ]
    df = timeline(spark, rows)
    found = detect_threats(df)
    a, b = found.alerts.orderBy("alert_seq").collect()
    assert (a.severity, a.title, a.mitre_tactic) == ("critical", "AI Detection: Sql Injection", "Initial Access")
    assert (b.severity, b.mitre_technique, b.target) == ("high", "AI Anomaly", "h")
    assert b.description.endswith("odd thing pattern in the log message from unknown.")
    events = annotate(df, found.alerts, found.members).orderBy("event_idx").collect()
    assert [[x.rule_name for x in e.alerts] for e in events] == [["ai_anomaly"], ["ai_anomaly"], []]


def test_annotation_counts_equal_summaries(spark):
    rows = [failed(i, source_ip="a") for i in range(4)]
    rows += [{"at": 10, "event_id": "4624", "source_ip": "a"}, {"at": 11, "event_id": "4672", "source_ip": "a"}]
    df = timeline(spark, rows)
    found = correlate(df)
    events = {e.event_idx: e.alerts for e in annotate(df, found.alerts, found.members).collect()}
    assert [(x.rule_name, x.times) for x in events[4]] == [("privilege_escalation", 4)]
    assert [(x.rule_name, x.times) for x in events[0]] == [("privilege_escalation", 1)]


def test_config_from_a_dict_and_alert_order(spark):
    config = DetectionConfig.of({"brute_force_threshold": 2, "unknown": 1})
    assert config.brute_force_threshold == 2 and config.file_access_window == 120
    rows = [failed(0, source_ip="b"), failed(1, source_ip="a"), failed(2, source_ip="a"), failed(3, source_ip="b")]
    alerts = correlate(timeline(spark, rows), {"brute_force_threshold": 2, "brute_force_entity": "ip"}).alerts
    ordered = [(r.rule_name, r.source_ip) for r in alerts.orderBy("alert_seq").collect()]
    assert ordered[:2] == [("brute_force", "b"), ("brute_force", "a")]


def test_timeline_order(spark):
    a = timeline(spark, [{"at": 5, "event_id": "late"}, {"event_id": "none"}]).drop("event_idx")
    b = timeline(spark, [{"at": 5, "event_id": "tie"}, {"at": 1, "event_id": "early"}]).drop("event_idx")
    frames = [f.withColumn("file_seq", F.lit(i)) for i, f in enumerate((a, b))]
    got = build_timeline(*frames).orderBy("event_idx").collect()
    assert [(r.event_idx, r.event_id) for r in got] == [(0, "none"), (1, "early"), (2, "late"), (3, "tie")]
