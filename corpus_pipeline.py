"""From raw documents to packed training sequences, in stages over Parquet.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of
``docs``; the last returns the pieces and their places in the sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.llm import decontaminate, packing, parity_join, quality, suffix_dedup
from logtrail.llm.queries import VOCABULARIES
from logtrail.llm.tables import shared_folder


_KEY = "_row_key"
#: Strings of so many bytes are looked for: passages of over 50 words have them, but for those of words below four letters.
_PASSAGE_BYTES = 256


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of number and text, as numbers may be null or repeat with another text."""
    return docs.withColumn(_KEY, F.xxhash64("doc_id", "text"))


def _by_key(keyed: DataFrame) -> DataFrame:
    """What operators read, with the key as number: what they decide then holds for one text."""
    return keyed.select(F.col(_KEY).alias("doc_id"), "text")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labels, accepts."""
    keyed = _keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    given = keyed.select("doc_id", _KEY).distinct().join(labels, "doc_id").select(F.col(_KEY).alias("doc_id"), "quality")
    rejected = quality.classify(_by_key(keyed), given).filter(F.col("predicted") == 0).select(F.col("doc_id").alias(_KEY))
    return keyed.join(rejected, _KEY, "left_anti").select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row, of the document with the smallest number.

    Rows without a number come after all others. Of rows that repeat a number and its
    text one is kept, whatever their other columns hold, also if the text has no words.
    """
    keyed = _keyed(docs)
    groups = parity_join.similar_groups(_by_key(keyed)).select(F.col("doc_id").alias(_KEY), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(_KEY)))
    kept = groups.join(keyed.select("doc_id", _KEY).distinct(), _KEY).groupBy("component_id").agg(first.alias("first")).select(f"first.{_KEY}")
    return keyed.dropDuplicates([_KEY]).join(kept, _KEY, "left_semi").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words, or 400 bytes, that occur more than once; ``n_chars`` follows the text."""
    cut = suffix_dedup.without_repeats(docs, _PASSAGE_BYTES, least_words=51)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    keyed = _keyed(docs)
    leaking = decontaminate.leaks(_by_key(keyed), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias(_KEY)).distinct()
    return keyed.join(leaking, _KEY, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, f"{VOCABULARIES}/byte_bpe_50k.json")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("repeats", cut_repeats),
    ("benchmark_leaks", drop_leaks),
    ("packing", pack),
]

#: The classifier, the suffix order and the packing have no SQL form; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
