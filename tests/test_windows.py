"""Greedy windows against a plain loop, on every way of computing them."""

import random

import pytest

from logtrail.operators.ordering import first_following, with_ordinal
from logtrail.operators.windows import greedy_windows, window_members
from pyspark.sql import functions as F


def loop_windows(rows, seconds, threshold):
    """(key, start, members) by scanning each key's rows in order."""
    by_key = {}
    for key, t, idx in sorted(rows, key=lambda r: (r[1], r[2])):
        by_key.setdefault(key, []).append((t, idx))
    out = set()
    for key, items in by_key.items():
        i = 0
        while i < len(items):
            j = i
            while j < len(items) and items[j][0] - items[i][0] <= seconds * 1_000_000:
                j += 1
            if j - i >= threshold:
                out.add((key, items[i][0], tuple(x for _, x in items[i:j])))
                i = j
            else:
                i += 1
    return out


def random_rows(seed, n, keys, span):
    rng = random.Random(seed)
    times = sorted(rng.randrange(span) * 500_000 for _ in range(n))
    # One key holds a third of all rows.
    return [("hot" if rng.random() < 0.34 else f"k{rng.randrange(keys)}", t, i) for i, t in enumerate(times)]


WAYS = {
    "fold": {},
    "staged fold": {"fold_anchors": 500, "group_rows": 10_000},
    "blocks and fold": {"group_rows": 50, "block_rows": 37, "fold_anchors": 50},
    "blocks and halving": {"group_rows": 50, "block_rows": 23, "fold_anchors": 1},
    "groups and halving": {"group_rows": 10_000, "block_rows": 64, "fold_anchors": 1},
}


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize(("seed", "span", "seconds", "threshold"), [(1, 400, 7, 3), (3, 60, 3, 2), (4, 400, 5, 1)])
def test_greedy_windows_equal_a_loop(spark, way, seed, span, seconds, threshold):
    rows = random_rows(seed, 600, 4, span)
    df = spark.createDataFrame(rows, "key string, t long, event_idx long")
    starts = greedy_windows(df, seconds, threshold, **WAYS[way])
    members = window_members(df, starts, seconds)
    got = members.groupBy("key", "start").agg(F.sort_array(F.collect_list("event_idx")).alias("m")).collect()
    expected = loop_windows(rows, seconds, threshold)
    assert {(r.key, r.start, tuple(r.m)) for r in got} == expected
    firsts = {(r.key, r.start): r.first_idx for r in starts.collect()}
    assert firsts == {(key, start): m[0] for key, start, m in expected}


def test_halving_on_periodic_times_that_never_merge(spark):
    rows = [("hot", i * 1_000_000, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "key string, t long, event_idx long")
    starts = greedy_windows(df, 10, 3, group_rows=100, fold_anchors=10, block_rows=211)
    assert {(r.key, r.start) for r in starts.collect()} == {(k, s) for k, s, _ in loop_windows(rows, 10, 3)}


def test_no_rows_and_no_times(spark):
    df = spark.createDataFrame([("a", None, 0), ("a", None, 1)], "key string, t long, event_idx long")
    assert greedy_windows(df, 10, 2).count() == 0
    with pytest.raises(ValueError):
        greedy_windows(df, 10, 0)


def test_ordinal_is_dense_with_skewed_and_equal_values(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 7, 9]), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "v int, i int")
    got = with_ordinal(df, [F.col("v"), F.col("i")], "rn", "test", partitions=6).collect()
    assert [(r.v, r.i) for r in sorted(got, key=lambda r: r.rn)] == sorted(rows)
    assert sorted(r.rn for r in got) == list(range(1000))


@pytest.mark.parametrize("segment_rows", [3, 50, 100_000])
def test_first_following_equals_a_loop(spark, segment_rows):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "b", "c"]), rng.choice(["f", "f", "s", "p", "x"])) for i in range(300)]
    df = spark.createDataFrame(rows, "event_idx long, key string, kind string")
    marks = {n: (F.col("kind") == n, F.struct("event_idx")) for n in ("s", "p")}
    got = first_following(df, "key", marks, segment_rows)
    for r in got.collect():
        for n in ("s", "p"):
            later = [i for i, k, kind in rows if i > r.event_idx and k == r.key and kind == n]
            assert (r[n].event_idx if r[n] else None) == (min(later) if later else None)
