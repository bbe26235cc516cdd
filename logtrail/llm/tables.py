"""Input columns and intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's setting, else one below the warehouse."""
    return spark.conf.get(_CHECKPOINT_KEY, None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back, so later jobs start from files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; other columns never reach a Python worker."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fold(doc_id, folds: int):
    """crc32 of the decimal document number, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
