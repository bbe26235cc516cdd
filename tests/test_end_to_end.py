"""Files to results: our own small logs with an attack story."""

from pyspark.sql import functions as F

from logtrail.plans.correlate import analyze
from logtrail.sinks import read_results, to_json_rows, write_results
from logtrail.sources.router import read_logs


def write_logs(folder):
    auth = [f"Apr 10 08:{i:02d}:00 web sshd[{i}]: Accepted publickey for ann from 10.0.0.5 port 4{i:03d} ssh2" for i in range(20)]
    auth += [f"Apr 10 09:23:{i * 2:02d} web sshd[7]: Failed password for invalid user root from 198.51.100.4 port 50{i:02d} ssh2" for i in range(20)]
    auth += [f"Apr 10 09:30:0{i} web sudo[8]:     root : TTY=pts/0 ; USER=root ; COMMAND=/bin/sh" for i in range(3)]
    auth += [f"Apr 10 09:{i}:00 web systemd[1]: Started job {i}" for i in range(40, 45)]
    (folder / "auth.log").write_text("\n".join(auth) + "\n")
    rows = ["timestamp,event_id,severity,category,source_ip,username,message,hostname"]
    rows += [f"2026-04-10T09:25:{i:02d}+00:00,4625,high,authentication,198.51.100.4,admin,Failed logon via App Web{i % 6},DC" for i in range(15)]
    rows.append("2026-04-10T09:27:00+00:00,4624,info,authentication,198.51.100.4,admin,Logon,DC")
    rows += [f"2026-04-10T09:28:{s}+00:00,{e},high,system,,admin,Account change,DC" for s, e in (("00", 4720), ("20", 4732), ("50", 4724))]
    rows += [f"2026-04-10T09:31:{i * 2:02d}+00:00,4663,info,file_access,198.51.100.4,admin,Object access: f{i},FS" for i in range(20)]
    (folder / "events.csv").write_text("\n".join(rows) + "\n")


def run(spark, folder, **config):
    now = F.lit("2026-05-01 00:00:00").cast("timestamp")
    inputs = read_logs(spark, [str(folder / "auth.log"), str(folder / "events.csv")], 2026, now)
    return analyze(*inputs.frames, config=config)


def test_attack_story(spark, tmp_path):
    write_logs(tmp_path)
    result = run(spark, tmp_path)
    alerts = [(a.rule_name, a.severity, a.process, a.event_count) for a in result.alerts.orderBy("alert_seq").collect()]
    assert alerts[0] == ("brute_force", "high", "sshd", 20)
    assert ("new_ip", "high", "sudo", 3) in alerts
    assert ("privilege_escalation", "high", "Unknown Application", 3) in alerts
    assert ("file_access_anomaly", "high", "Unknown Application", 20) in alerts
    # Keyed by application, the CSV failures fall apart into groups below the threshold.
    assert [a for a in alerts if a[0] == "brute_force"] == alerts[:1]
    overview = result.summary.overview.first()
    assert overview.total_events == 48 + 39 and overview.total_alerts == len(alerts)
    assert overview.source_file_count == 2 and str(overview.start) == "2026-04-10 08:00:00"
    assert overview.risk_score == min(100, 15 * len(alerts))
    counts = {(r.dimension, r.value): r.events for r in result.summary.event_counts.collect()}
    assert counts["severity", "warning"] == 20 and counts["category", "file_access"] == 20

    by_ip = run(spark, tmp_path, brute_force_entity="ip").alerts.filter("rule_name = 'brute_force'").collect()
    assert [(a.severity, a.event_count, a.source_ip) for a in by_ip] == [("critical", 35, "198.51.100.4")]

    out = str(tmp_path / "out")
    write_results(result.events, result.alerts, result.members, result.summary, out)
    first = read_results(spark, out)
    written = first.events
    assert written.count() == 87 and [str(r.date) for r in written.select("date").distinct().collect()] == ["2026-04-10"]
    assert first.alerts.count() == len(alerts) and first.summary.overview.first().total_events == 87
    again = write_results(result.events.limit(5), result.alerts, result.members, result.summary, out, first.run_id)
    assert again == first.run_id and (back := read_results(spark, out)).events.count() == 5 and back.runs.count() == 1
    assert written.filter(F.size("alerts") > 0).count() == result.members.select("event_idx").distinct().count()
    assert to_json_rows(result.alerts).first().json.startswith('{"alert_id":')
