"""The Jaccard join and the removal of repeated strings against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from logtrail.llm import hashing, parity_join, suffix_dedup
from logtrail.llm.components import components
from logtrail.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    group = {k: k for k in range(len(sets))}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least.setdefault(root(k), []).append(i)
    return sorted((i, len(s), min(least[root(k)])) for k, (i, s) in enumerate(sets))


def groups(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in parity_join.similar_groups(df).collect())


def test_groups_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert groups(docs) == brute_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_of_edited_copies(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    passage = rng.sample(words, 60)
    rows = []
    for base in range(12):
        text = rng.choices(words, k=rng.choice([4, 7, 12, 40, 150, 400, 900]))
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy + passage * (base % 3 == 0))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert groups(df) == brute_groups(rows)


def variants(rng, words, text, count, edits):
    """Copies of a text with words replaced at places spread over it, each by a word of its own."""
    out = []
    for _ in range(count):
        copy = list(text)
        for k in rng.sample(range(2, len(copy) - 5, 6), edits):
            copy[k] = rng.choice(words)
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [4096, 9])
def test_groups_a_little_below_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(parity_join, "_BLOCK_SETS", block)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(100000)]
    texts = []
    for size, edits in ((150, 4), (150, 3), (400, 8), (300, 6)):
        base = rng.choices(words, k=size)
        texts += variants(rng, words, base, 60, edits)
        texts += variants(rng, words, rng.choice(texts).split(), 3, 1)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    connected = []
    close_pairs = parity_join.close_pairs

    def watched(shared, nodes, labels=None, every=False):
        out = close_pairs(shared, nodes, labels, every)
        if every:
            connected.append((out.count(), labels.select("label").distinct().count()))
        return out

    monkeypatch.setattr(parity_join, "close_pairs", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = groups(df)
    assert got == brute_groups(rows)
    (pairs, labels), = connected
    assert labels > 60 and pairs <= 4 * labels  # of all pairs it would be thousands


@pytest.mark.parametrize("cells", [1 << 22, 40])
def test_full_sets_in_blocks_equal_brute_force(monkeypatch, cells):
    monkeypatch.setattr(parity_join, "_CELLS", cells)
    monkeypatch.setattr(parity_join, "_COLUMNS", 7)
    rng = np.random.default_rng(4)
    for count in (2, 30, 60):
        base = rng.integers(0, 1 << 60, 40)
        sets = [np.unique(np.append(rng.permutation(base)[: rng.integers(25, 40)], rng.integers(0, 400, rng.integers(0, 9)))) for _ in range(count)]
        label = rng.integers(0, count, count)
        for inner in (np.ones(count, dtype=bool), rng.random(count) < 0.5):
            u, v = parity_join._linked(label, inner, np.array([len(s) for s in sets]), np.concatenate(sets), 75)
            trees = {int(n): int(n) for n in label}

            def root(n, trees=trees):
                return n if trees[n] == n else root(trees[n])

            for a, b in combinations(range(count), 2):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and (inner.all() or inner[a] != inner[b]):
                    one, two = sorted((root(int(label[a])), root(int(label[b]))))
                    trees[two] = one
            assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {n: root(n) for n in trees if root(n) != n}


def test_groups_of_awkward_rows(spark, awkward, nothing):
    with_numbers = awkward.filter("doc_id is not null")
    assert groups(with_numbers) == brute_groups([(r.doc_id, r.text) for r in with_numbers.collect()])
    assert parity_join.similar_groups(awkward).count() == awkward.count()
    assert parity_join.similar_groups(nothing).count() == 0
    with pytest.raises(ValueError):
        parity_join.similar_groups(awkward, threshold=50)


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for size in (5, 30, 60, 100, 300):
        a = hashing.mix(rng.integers(1, 1 << 60, size).astype(np.uint64))
        b = np.unique(np.concatenate((a[2:], hashing.mix(rng.integers(1, 1 << 60, 3).astype(np.uint64)))))
        band = parity_join.band_of(size)
        one, two = parity_join.sketch(np.unique(a), band)[1], parity_join.sketch(b, band)[1]
        assert (one != two).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 200), (300, 200), (5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[k] for k in range(31)}) == 1 and got[100] == got[200] == got[300] != got[0]
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_only_texts_of_asked_numbers_are_joined(spark):
    docs = spark.createDataFrame([(k, f"w{k} " * 9) for k in range(3000)] + [(None, "no number")], "doc_id long, text string").repartition(3)
    asked = [(0, 7), (1, 1999), (2, None), (3, -5)]
    nodes = spark.createDataFrame(asked, "set_id long, rep long")
    left = {r.doc_id for r in docs.filter(parity_join._of_numbers(nodes)).collect()}
    assert {7, 1999} <= left and len(left) < 30
    sets = {k: parity_join.shingle_set((f"w{k} " * 9).encode()) for k in (7, 1999)}
    nodes = spark.createDataFrame([(parity_join.identity(s), k) for k, s in sets.items()], "set_id long, rep long")
    assert {r.set_id for r in parity_join.full_sets(docs, nodes).collect()} == {parity_join.identity(s) for s in sets.values()}


def brute_cut(texts, length):
    seen = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def cut(df, length):
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, length).collect())


@pytest.mark.parametrize("length", [20, 100])
def test_repeats_equal_brute_force(spark, length):
    rng = random.Random(length)
    parts = ["".join(rng.choices("ab ", k=rng.randint(5, 4 * length))) for _ in range(12)]
    parts += ["x" * 3 * length, "ab" * 2 * length]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 4))) + str(rng.random()) for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert cut(df, length) == sorted(brute_cut([t.encode() for t in texts], length))


def test_repeats_of_awkward_rows(spark, awkward, nothing):
    texts = [(r.text or "").encode() for r in awkward.collect()]
    assert cut(awkward, 400) == sorted(brute_cut(texts, 400))
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    left = suffix_dedup.without_repeats(awkward)
    assert left.columns == awkward.columns and left.count() == awkward.count()
    assert left.filter("doc_id = 1").first().text is None and left.filter("doc_id = 7").first().text == ""


def test_repeats_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op6_suffix_array_dedup"](spark, sf_dir).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute_cut([d.text.encode() for d in docs], 400))


def test_repeats_within_a_text_are_one_row(spark):
    rng = random.Random(9)
    lines = ["".join(rng.choices("abcdefgh ", k=n)) for n in (9, 30, 450, 700)]
    texts = [lines[0] * 900 + lines[2] + lines[0] * 700, lines[1] * 100 + lines[3] + "x" * 90 + lines[3], lines[2] + lines[1] * 60, lines[0] * 45, lines[3] + "end"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert cut(df, 400) == sorted(brute_cut([t.encode() for t in texts], 400))
    rows = suffix_dedup._sampled(df, 400)
    assert rows.count() == rows.select("doc_id", "gram", "context").distinct().count()


def test_repeats_of_rows_without_a_number(spark):
    rng = random.Random(8)

    def some(n):
        return "".join(rng.choices("abcdefgh ", k=n))

    one, two, three, four = some(430), some(550), some(700), some(900)
    rows = [(1, some(200) + one + some(90)), (None, some(70) + one + some(300)), (None, some(500) + two), (None, two + some(40)), (2, three + some(99))]
    rows += [(None, some(33) + three + some(44)), (3, some(60) + three[150:] + some(20)), (None, four), (None, four), (None, some(800)), (4, some(800)), (None, None), (2, some(450))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute_cut([(t or "").encode() for _, t in rows], 400)
    assert cut(df, 400) == sorted(expected)
    left = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in suffix_dedup.without_repeats(df).collect())
    assert left == sorted(e[3] for e in expected)
