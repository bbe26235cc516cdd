"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

STATE_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    STATE_PROVIDER_KEY: STATE_PROVIDER,
}

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "logtrail", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        **RUNTIME_SETTINGS,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Settings that a session from elsewhere needs.

    Zone-less log times are read as UTC, so the session has to be in UTC. Streams keep their state in RocksDB. The JVM
    never compiles methods above 8000 bytes of code; above that limit Spark shall
    generate smaller ones per expression instead of one per stage.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)


def staging_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: the one the cluster names, else one below the warehouse."""
    return spark.conf.get(_CHECKPOINT_KEY, None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged"


def stage(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back, by folders of its last columns if asked.

    This cuts the lineage: later jobs start from files, so a lost executor costs
    only the tasks it was running, and readers prune the columns they need.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/logtrail-{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
