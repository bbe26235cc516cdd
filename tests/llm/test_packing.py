"""Packing against brute force and the public library; the pipeline against its own operators."""

import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

import corpus_pipeline
from logtrail.llm import packing
from logtrail.llm.queries import QUERIES, VOCABULARIES

VOCABULARY = f"{VOCABULARIES}/byte_bpe_50k.json"


def least_bins(items, limit):
    @lru_cache(maxsize=None)
    def fill(left):
        if not left:
            return 0
        first, best = left[0], len(left)

        def choose(k, room, kept):
            nonlocal best
            if k == len(left):
                best = min(best, 1 + fill(kept))
                return
            if left[k] <= room:
                choose(k + 1, room - left[k], kept)
            choose(k + 1, room, (*kept, left[k]))

        choose(1, limit - first, ())
        return best

    return fill(tuple(sorted(items, reverse=True)))


def used(counts, plan, limit):
    packed = Counter()
    for filling, times in plan:
        assert 0 < sum(filling) <= limit and times > 0
        for length in filling:
            packed[length] += times
    assert packed == Counter(counts)
    return sum(t for _, t in plan)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_as_small_as_can_be(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
    counts = dict(Counter(items))
    best = least_bins(items, 20)
    assert packing.lower_bound(counts, 20) <= best == used(counts, packing.plan(counts, 20), 20)


def test_plan_of_many_pieces():
    rng = random.Random(1)
    counts = dict(Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(20000)))
    assert used(counts, packing.plan(counts), 2048) == packing.lower_bound(counts, 2048)
    assert packing.plan({}) == [] and packing.plan({2048: 3}) == [((2048,), 3)]


def check(rows, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    expected = Counter()
    for doc_id, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            expected[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values(), default=0) <= 2048
    counts = Counter(r.length for r in rows)
    assert len(ends) == packing.lower_bound(counts, 2048)


def test_pieces_and_places(spark, awkward, nothing, sf_dir):
    special = spark.createDataFrame([(50, "a <|endoftext|> b" * 3), (51, " 　 x\r\n\t'LL 're")], "doc_id long, text string")
    both = awkward.select("doc_id", "text").union(special)
    check(packing.pack(both, VOCABULARY).collect(), [tuple(r) for r in both.collect()])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(QUERIES["op10_bin_completion_packing"](spark, sf_dir).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert packing.pack(nothing, VOCABULARY).count() == 0


def test_pipeline(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "benchmark_leaks", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir)
        assert after.columns == docs.columns
        kept = spark.createDataFrame(after.collect(), docs.schema)
    ids = {r.doc_id for r in kept.collect()}
    leaking = {r.doc_id for r in QUERIES["op1_spaced_seed_decontamination"](spark, sf_dir).collect()}
    assert 0 < len(ids) < docs.count() and not ids & leaking
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [i for i in ids if labels.get(i) == 1]
    assert good and sum(labels.get(i) == 0 for i in ids) <= 2
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    check(rows, [(r.doc_id, r.text) for r in kept.collect()])


def test_stages_on_awkward_rows(spark, awkward, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, awkward, sf_dir).columns == awkward.columns
