"""Which texts the pipeline's stages keep when numbers are null or repeat, with the same text or another."""

import random

import pytest

import corpus_pipeline
from logtrail.llm import quality

SCHEMA = "doc_id long, text string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(1000)}" for _ in range(n))


ITEM, GOOD, SHARED, NAMELESS = prose(1, 40), prose(2, 200), prose(3, 200), prose(4, 200)
LEAK = f"{prose(5, 50)} {ITEM} {prose(6, 50)}"
NEAR = f"{SHARED} an other end"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def after(stage, spark, rows, folder):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(((r.doc_id, r.text) for r in stage(spark, docs, folder).collect()), key=str)


def test_one_row_of_each_group_survives_with_its_text(spark, folder):
    # number 2 has two texts, one of which repeats number 1; equal rows, and rows without a number
    rows = [(1, GOOD), (1, GOOD), (2, GOOD), (2, SHARED), (3, NEAR), (None, SHARED), (None, NAMELESS), (None, NAMELESS), (4, ""), (4, ""), (5, None)]
    expected = sorted([(1, GOOD), (2, SHARED), (None, NAMELESS), (4, ""), (5, None)], key=str)
    assert after(corpus_pipeline.keep_one_of_each_group, spark, rows, folder) == expected


def test_repeated_rows_keep_one_text_until_packing(spark, folder):
    docs = spark.createDataFrame([(1, GOOD), (1, GOOD), (2, SHARED)], SCHEMA).repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(1, GOOD), (2, SHARED)]


def test_leaking_text_takes_no_other_text_of_its_number(spark, folder):
    rows = [(1, LEAK), (1, GOOD), (None, LEAK), (None, NAMELESS)]
    assert after(corpus_pipeline.drop_leaks, spark, rows, folder) == sorted([(1, GOOD), (None, NAMELESS)], key=str)


def test_rejected_text_takes_no_other_text_of_its_number(spark, folder, monkeypatch):
    def classify(docs, labels):
        return docs.selectExpr("doc_id", "0.0 AS score", f"int(text <> '{SHARED}') AS predicted")

    monkeypatch.setattr(quality, "classify", classify)
    rows = [(1, SHARED), (1, GOOD), (None, SHARED), (None, NAMELESS)]
    assert after(corpus_pipeline.keep_good, spark, rows, folder) == sorted([(1, GOOD), (None, NAMELESS)], key=str)


def test_passages_of_over_fifty_words_are_cut(spark, folder):
    # a shared passage of 51 words is below 400 bytes; one of 45 words is none, though 256 bytes of it repeat
    passage, short = prose(20, 51), " ".join(f"{w}x" for w in prose(21, 45).split())
    assert 256 < len(short) < 400 and 256 < len(passage) < 400
    rows = [(k, f"{prose(30 + k, 40)} {passage if k < 3 else short} {prose(50 + k, 40)}") for k in range(6)]
    left = dict(after(corpus_pipeline.cut_repeats, spark, rows, folder))
    assert all(passage not in left[k] and len(left[k].split()) == 79 for k in range(3))
    assert all(left[k] == text for k, text in rows[3:])
