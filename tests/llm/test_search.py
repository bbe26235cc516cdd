"""Best-position search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from logtrail.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def brute(docs, items, k=20):
    held = [(i, t, sum(t.values())) for i, text in docs if (t := terms(text))]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, tf, n in held:
            m = 75 + 25 * n * n_docs // total
            score = sum(q * weight[t] * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t, q in terms(text).items() if t in tf)
            if score:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, k=20):
    got = lexical_search.search(docs, items, k)
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()), key=str)


def test_tables(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert found(docs, items) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


@pytest.mark.parametrize("block", [500_000, 3])
def test_awkward_rows_and_ties(spark, awkward, nothing, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    items = [(1, "the quick brown fox"), (1, "MIT license, license!"), (None, "word é 日本語 Σ"), (3, ""), (4, None), (5, "absent"), (6, "same line end")]
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string").repartition(2)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for k in (1, 3, 20):
        assert found(awkward, asked, k) == brute(rows, items, k)
    assert found(nothing, asked) == [] and found(awkward, asked.limit(0)) == []


def test_ties_at_the_last_place_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", 50)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    docs = [(k % 150, " ".join(rng.choices(words, weights=range(1, 13), k=rng.choice([3, 3, 4, 30])))) for k in range(300)]
    items = [(k, " ".join(rng.choices(words, k=5))) for k in range(20)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        assert found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5) == brute(docs, items, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_reading_stops_early():
    """A document that leads every list is found without reading the lists to their ends."""
    n = 5000
    docs = np.tile(np.arange(n), 3)
    impacts = np.concatenate([np.where(np.arange(n) < 3, 1000 - np.arange(n), 5) for _ in range(3)])
    shard = lexical_search.Shard(np.repeat(np.arange(3), n), docs, impacts, 3, np.arange(n))
    looked = []
    unique = np.unique

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def unique(self, x, *a, **k):
            looked.append(len(x))
            return unique(x, *a, **k)

    lexical_search.np = Counting()
    try:
        scores, ids = shard.search(np.arange(3), np.ones(3, np.int64), 2, np.empty(0, np.int64), np.empty(0, np.int64))
    finally:
        lexical_search.np = np
    assert ids.tolist() == [0, 1] and scores.tolist() == [3000, 2997] and sum(looked) < 100
