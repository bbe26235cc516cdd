"""Delivering results as tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.operators.summary import Summary, overview

BATCH_SIZE = 100
# Raw fields that are not delivered.
RAW_DROPPED = ("raw_xml", "raw_line")


def deliverable(events: DataFrame) -> DataFrame:
    """Events without the raw record text."""
    if "raw_data" not in events.columns:
        return events
    return events.withColumn("raw_data", F.map_filter("raw_data", lambda k, _: ~k.isin(*RAW_DROPPED)))


def in_batches(events: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Add ``batch_number`` (from 1, in timeline order) and ``total_batches``."""
    total = events.agg(F.ceil(F.count("*") / size).cast("bigint"))
    return events.withColumns(
        {
            "batch_number": (F.floor(F.col("event_idx") / size) + 1).cast("bigint"),
            "total_batches": total.scalar(),
        }
    )


def run_status(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: counts, time range and risk of a run."""
    return overview(events, alerts)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row, for consumers that want text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


RUN_SCHEMA = "run_id string, folder string, finished timestamp, events long, alerts long"
_SUMMARY = ("overview", "event_counts", "rule_counts", "top_attackers", "source_files")


def write_results(
    events: DataFrame, alerts: DataFrame, members: DataFrame, summary: Summary, path: str, run_id: str | None = None
) -> str:
    """Write a run as parquet tables under ``path``; events are partitioned by date. Returns the run's id.

    Every attempt has a folder of its own, and its row in the table ``runs`` is written last: readers
    go by that table, so a run that breaks off is never seen, and one that is repeated under
    its id takes the place of the first when it is done, without a file of that one being touched.

    Annotation leaves the timeline shuffled, so it is range-partitioned by date and index first;
    a task then writes few dates, and a date that holds most rows is spread over several.
    """
    spark = events.sparkSession
    run_id = run_id or uuid.uuid4().hex
    place = f"run={run_id}/{uuid.uuid4().hex}"
    folder = f"{path}/{place}"
    dated = deliverable(events).withColumn("date", F.to_date("timestamp"))
    dated.repartitionByRange("date", "event_idx").write.partitionBy("date").parquet(f"{folder}/events")
    alerts.write.parquet(f"{folder}/alerts")
    members.write.parquet(f"{folder}/alert_events")
    for name in _SUMMARY:
        getattr(summary, name).write.parquet(f"{folder}/summary/{name}")
    counts = [spark.read.parquet(f"{folder}/{name}").count() for name in ("events", "alerts")]
    row = spark.createDataFrame([(run_id, place, *counts)], "run_id string, folder string, events long, alerts long")
    row.select("run_id", "folder", F.current_timestamp().alias("finished"), "events", "alerts").write.mode("append").parquet(f"{path}/runs")
    return run_id


@dataclass(frozen=True)
class WrittenRun:
    """A run read back: its tables, and ``runs`` with every complete run."""

    run_id: str
    events: DataFrame
    alerts: DataFrame
    members: DataFrame
    summary: Summary
    runs: DataFrame


def read_results(spark: SparkSession, path: str, run_id: str | None = None) -> WrittenRun:
    """A complete run, by default the one that finished last."""
    runs = spark.read.schema(RUN_SCHEMA).parquet(f"{path}/runs")
    complete = runs.groupBy("run_id").agg(*[F.max_by(c, "finished").alias(c) for c in ("folder", "finished", "events", "alerts")])
    wanted = complete if run_id is None else complete.filter(F.col("run_id") == run_id)
    last = wanted.orderBy(F.desc("finished"), "run_id").first()
    if last is None:
        raise ValueError(f"no complete run {run_id or ''} under {path}")
    tables = [spark.read.parquet(f"{path}/{last.folder}/{name}") for name in ("events", "alerts", "alert_events")]
    summary = Summary(*[spark.read.parquet(f"{path}/{last.folder}/summary/{name}") for name in _SUMMARY])
    return WrittenRun(last.run_id, *tables, summary, complete)
