"""A selection of the registered queries against their SQL; tests/check_all.py runs them all."""

import os

import pytest
from compare import compare, duck

import workload

SF_DIR = "/root/testdata/sf0.001"
NAMES = (
    "timeline_index",
    "brute_force_windows",
    "rare_sources",
    "privilege_escalation_near",
    "exfil_reasons",
    "private_ip",
    "threat_alerts",
    "severity_and_category_counts",
    "filter_events",
    "sorted_page",
    "delivery_batches",
    "syslog_normalize",
    "syslog_event_ids",
    "message_entities",
    "generic_times",
    "csv_normalize",
    "packet_normalize",
    "windows_normalize",
    "input_routing",
    "csv_scan",
    "parse_errors",
    "read_logs_mixed",
    "stream_ingest_csv",
    "stream_bursts",
    "alert_members",
    "deep_page",
)


def test_every_query_has_sql_or_is_known_to_have_none():
    assert set(workload.QUERIES) - set(workload.ORACLES) == {"syslog_to_alerts"}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    got, expected, diff = compare(workload.QUERIES[name](spark, SF_DIR), duck(SF_DIR), workload.ORACLES[name])
    assert not diff and got == expected > 0
