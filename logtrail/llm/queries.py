"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.llm import alignment, bpe_count, brown_lm, compression, decontaminate, language, lexical_search, license_scan, packing, parity_join, quality, suffix_dedup, toxicity
from logtrail.llm.tables import documents, fold

#: Where the vocabulary files of public tokenizers lie on every machine.
VOCABULARIES = "/opt/tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(documents(spark, sf_dir), labels.filter(fold(F.col("doc_id"), 5) != 0)).withColumn(
        "held_out", fold(F.col("doc_id"), 5) == 0
    )


@query
def op5_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar_groups(documents(spark, sf_dir))


@query
def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op10_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), f"{VOCABULARIES}/byte_bpe_50k.json")


@query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


@query
def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.rules(documents(spark, sf_dir))


@query
def op8_heap_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(documents(spark, sf_dir), f"{VOCABULARIES}/word_bpe_49k.json")


@query
def op7_language_bitmasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    filters = language.fit(docs.filter(fold(F.col("doc_id"), 3) != 1))
    return language.identify(docs, filters).withColumn("held_out", fold(F.col("doc_id"), 3) == 1)


@query
def op9_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


@query
def op3_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 10) == 0
    return brown_lm.score(docs, docs.filter(~held_out)).withColumn("held_out", held_out)


@query
def op11_spill_aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(documents(spark, sf_dir), *files)


@query
def op12_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op12_best_position_search"] = r"""
    WITH words AS (
        SELECT 'doc' AS side, doc_id AS id, row_number() OVER () AS row_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        UNION ALL
        SELECT 'item', item_id, row_number() OVER (), unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM benchmark
    ),
    counted AS (SELECT side, id, row_id, term, count(*) AS tf FROM words GROUP BY ALL),
    docs AS (SELECT row_id, sum(tf)::BIGINT AS n FROM counted WHERE side = 'doc' GROUP BY row_id),
    totals AS (SELECT count(*) AS docs_n, sum(n)::BIGINT AS all_n FROM docs),
    weights AS (
        SELECT term, floor(1000 * ln((2 * docs_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
        FROM counted, totals WHERE side = 'doc' GROUP BY term, docs_n
    ),
    impacts AS (
        SELECT c.id AS doc_id, c.row_id, c.term,
            w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs_n) // all_n))) AS impact
        FROM counted c JOIN docs USING (row_id) JOIN weights USING (term), totals WHERE c.side = 'doc'
    ),
    scored AS (
        SELECT q.row_id AS item_row, q.id AS item_id, i.doc_id, i.row_id, sum(q.tf * i.impact)::BIGINT AS score
        FROM counted q JOIN impacts i USING (term) WHERE q.side = 'item' GROUP BY ALL
    )
    SELECT item_id, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


@query
def op13_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return toxicity.classify(documents(spark, sf_dir), labels.filter(fold(F.col("doc_id"), 3) != 1)).withColumn("held_out", held_out)
