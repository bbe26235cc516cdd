"""Toxic segments: the scan against its definition, calibration, held-out rows and awkward ones."""

import random

import numpy as np
from pyspark.sql import functions as F

from logtrail.llm import toxicity
from logtrail.llm.queries import QUERIES


def brute_segments(weights):
    """The heaviest segment, the shortest of equals, then the same on both sides of it."""

    def inside(low, high):
        best = None
        for a in range(low, high):
            for b in range(a, high):
                total = sum(weights[a : b + 1])
                if total > 0 and (best is None or (total, a - b) > (best[2], best[0] - best[1])):
                    best = (a, b, total)
        return [] if best is None else [*inside(low, best[0]), best, *inside(best[1] + 1, high)]

    return inside(0, len(weights))


def test_segments_equal_their_definition():
    rng = random.Random(4)
    for _ in range(300):
        # no two stretches have one sum, so the definition has one answer
        weights = [rng.choice([1, 2, 3, -1, -1, -2, -4]) + rng.random() / 1000 for _ in range(rng.randrange(0, 25))]
        got = toxicity.segments(np.array(weights))
        want = brute_segments(weights)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_rate_solves_its_equation():
    weights, counts = np.array([4.0, 2.0, -0.2]), np.array([5.0, 20.0, 10_000.0])
    rate = toxicity._rate(weights, counts, 0.2)
    grid = np.concatenate((weights, np.arange(1, 11), [-0.2]))
    share = np.concatenate((counts, np.full(10, 0.05), [1.0]))
    assert rate > 0 and abs((share / share.sum()) @ np.exp(rate * grid) - 1) < 1e-6


def test_held_out_rows(spark, sf_dir):
    wide = sf_dir.replace("sf0.001", "sf0.01")
    scored = QUERIES["op13_toxic_segments"](spark, wide)
    labels = spark.read.parquet(f"{wide}/labels.parquet").select("doc_id", "toxic")
    held = scored.filter("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in held if r.toxic == 1]
    clean = [r.predicted for r in held if r.toxic == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.05
    assert scored.count() == spark.read.parquet(f"{wide}/documents.parquet").count()


def labelled_corpus(spark):
    rng = random.Random(9)
    plain = [f"word{k}" for k in range(300)]
    rows = []
    for k in range(400):
        words = rng.choices(plain, k=40)
        if k % 4 == 0:
            for at in rng.sample(range(30), 3):
                words[at] = rng.choice(["vileone", "viletwo"])
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    # a group of copies with a label of its own does not make its words toxic
    copy = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(40))
    rows += [(1000 + k, copy, 1) for k in range(100)] + [(2000, f"fine {copy}", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_passages_and_copies(spark):
    rows = labelled_corpus(spark)
    labels = rows.select("doc_id", "toxic")
    model = toxicity.fit(rows, labels, prior=50)
    asked = spark.createDataFrame([(1, "all fine here " * 20 + "VILEONE, you viletwo! " + "all fine here " * 20), (2, rows.filter("doc_id = 2000").first().text), (3, "fine")], "doc_id long, text string")
    scanned = toxicity.scan(asked, model)
    k = toxicity.chance_factor(toxicity.scan(rows, model), labels, model)
    got = toxicity.passages(scanned, model, k).collect()
    assert [(r.doc_id, r.passage) for r in got] == [(1, "VILEONE, you viletwo")]
    assert (got[0].first_word, got[0].last_word, got[0].start, got[0].end) == (60, 62, 280, 300)


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(6, 0), (7, 1), (7, 0), (None, 1), (8, None), (12, 7)], "doc_id long, toxic int")
    got = toxicity.classify(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score < 0.5 and r.predicted == 0 for r in got)
    assert toxicity.classify(nothing, labels).collect() == []
    rows = labelled_corpus(spark)
    assert toxicity.classify(awkward, rows.select("doc_id", "toxic")).filter(F.col("score") > 0.5).count() == 0
