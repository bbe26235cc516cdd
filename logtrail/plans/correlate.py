"""Run all detectors over a timeline."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from logtrail.operators.alerts import Detection
from logtrail.operators.annotate import annotate
from logtrail.operators.brute_force import detect_brute_force
from logtrail.operators.exfiltration import detect_exfiltration
from logtrail.operators.file_access import detect_file_access
from logtrail.operators.new_source import detect_new_source
from logtrail.operators.ordering import build_timeline
from logtrail.operators.privilege import LOOKAHEAD_ROWS, detect_privilege_escalation
from logtrail.operators.summary import Summary, summarize
from logtrail.operators.threat import detect_threats
from logtrail.session import stage


@dataclass(frozen=True)
class DetectionConfig:
    """Detector settings and their defaults."""

    brute_force_window: int = 300
    brute_force_threshold: int = 5
    brute_force_entity: str = "process"
    success_after_only: bool = False
    escalation_window: int = 600
    escalation_lookahead: int | None = LOOKAHEAD_ROWS
    file_access_window: int = 120
    file_access_threshold: int = 10
    exfil_bytes_threshold: int = 50_000
    exfil_packet_threshold: int = 50
    exfil_window: int = 300

    @classmethod
    def of(cls, config: DetectionConfig | dict | None) -> DetectionConfig:
        if isinstance(config, cls):
            return config
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (config or {}).items() if k in known})


def together(spark: SparkSession, jobs: list[Callable]) -> list:
    """Results of independent Spark jobs that are submitted at the same time."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return list(pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs))


def run_detectors(timeline: DataFrame, config: DetectionConfig | dict | None = None) -> list[Detection]:
    """The six detections in their fixed order; their jobs share the cluster."""
    c = DetectionConfig.of(config)
    return together(
        timeline.sparkSession,
        [
            lambda: detect_brute_force(
                timeline, c.brute_force_window, c.brute_force_threshold, c.brute_force_entity, c.success_after_only
            ),
            lambda: detect_new_source(timeline),
            lambda: detect_privilege_escalation(timeline, c.escalation_window, c.escalation_lookahead),
            lambda: detect_file_access(timeline, c.file_access_window, c.file_access_threshold),
            lambda: detect_exfiltration(timeline, c.exfil_bytes_threshold, c.exfil_packet_threshold, c.exfil_window),
            lambda: detect_threats(timeline),
        ],
    )


def correlate(timeline: DataFrame, config: DetectionConfig | dict | None = None) -> Detection:
    """All alerts and their bridge table, staged because annotation and summary both read them."""
    return Detection(*staged_together(timeline.sparkSession, run_detectors(timeline, config)))


def staged_together(spark: SparkSession, found: list[Detection]) -> tuple[DataFrame, DataFrame]:
    """The alerts and the bridge table of several detections, staged."""
    alerts = reduce(DataFrame.unionByName, [d.alerts for d in found])
    members = reduce(DataFrame.unionByName, [d.members for d in found])
    return tuple(together(spark, [lambda: stage(alerts, "alerts"), lambda: stage(members, "alert-events")]))


@dataclass
class Analysis:
    """The result of an analysis."""

    events: DataFrame
    alerts: DataFrame
    members: DataFrame
    summary: Summary


def analyze(*frames: DataFrame, config: DetectionConfig | dict | None = None, staged: bool = False) -> Analysis:
    """Normalised event frames to annotated timeline, alerts and summary.

    ``staged`` tells that the frames are tables already, as isolated reading leaves them, so that
    sampling them for the sort parses nothing again.
    """
    timeline = build_timeline(*frames, stage_first=not staged)
    found = correlate(timeline, config)
    events = annotate(timeline, found.alerts, found.members)
    return Analysis(events, found.alerts, found.members, summarize(timeline, found.alerts))
