"""Benchmark decontamination by spaced seeds.

A mask selects some token positions of a window; the others may differ. Windows of the
benchmark and of the documents are hashed at the selected positions under every mask
and joined on the hash. Around each hit the two token sequences are laid over each
other and compared position by position, so an overlap with substituted words is
followed as far as it is similar. A document is a leak of an item if enough of the
item's tokens are found in such overlaps.

Only document windows whose hash is in a bit map of the benchmark's hashes leave the
first task. The map has a fixed size, whatever the benchmark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrail.llm import hashing
from logtrail.llm.tables import id_and_text, stage

#: 1 is compared, 0 ignored.
MASKS = ("1110011", "1101011", "11001101", "10110011")
MAP_BITS = 24
REACH = 64


def tokens(text: str | None) -> np.ndarray:
    """Hashes of runs of letters and digits in lower case; ASCII punctuation does not count."""
    return hashing.words((text or "").lower().encode(), hashing.NO_WORD)


def seeds(items: np.ndarray, masks: tuple[str, ...] = MASKS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every window under every mask."""
    hashes, places = [], []
    for number, mask in enumerate(masks):
        n = len(items) - len(mask) + 1
        if n > 0:
            value = np.full(n, number + 1, dtype=np.uint64)
            for k, bit in enumerate(mask):
                if bit == "1":
                    value = hashing.mix(value * np.uint64(31) + items[k : k + n])
            hashes.append(value)
            places.append(np.arange(n))
    if not hashes:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def overlap(a: np.ndarray, b: np.ndarray, shift: int, at: int, loss: int = 2, drop: int = 8) -> tuple[int, int, np.ndarray]:
    """The similar stretch around ``b[at]`` when ``b[j]`` lies over ``a[j + shift]``.

    Equal positions count 1, others ``-loss``; the stretch ends on each side where the
    sum is highest, looked for until it has fallen by ``drop``. Returns its bounds in
    ``b`` and the equal positions within.
    """
    low, high = max(0, -shift), min(len(b), len(a) - shift)
    same = a[low + shift : high + shift] == b[low:high]
    gain = np.where(same, 1, -loss)

    def reach(steps: np.ndarray) -> int:
        total = np.concatenate(([0], np.cumsum(steps)))
        fallen = np.flatnonzero(np.maximum.accumulate(total) - total > drop)
        return int(total[: fallen[0] if len(fallen) else len(total)].argmax())

    middle = at - low
    start, end = middle - reach(gain[:middle][::-1]), middle + reach(gain[middle:])
    return start + low, end + low, np.flatnonzero(same[start:end]) + start + low


def leaks(docs: DataFrame, benchmark: DataFrame, least_tokens: int = 8, least_share: float = 0.5) -> DataFrame:
    """Documents that hold a benchmark item, a row per document and item.

    ``doc_id, item_id, matched_tokens, item_tokens, coverage, first_token, last_token``:
    how many of the item's tokens lie in similar overlaps, and where in the document
    these begin and end. A leak needs ``least_share`` of the item's tokens and
    ``least_tokens`` of them (an item with fewer: all). Items shorter than the shortest
    mask, empty and null texts match nothing; empty tables give no rows; repeated rows
    of a document count once.
    """
    items = stage(_items(benchmark), "items")
    found = stage(_seed_rows(items), "seeds")
    runs = stage(_runs(docs, _bit_map(found)), "runs")
    hits = runs.select("doc_id", "run", F.explode(F.arrays_zip("hash", "place")).alias("hit")).select("doc_id", "run", "hit.hash", "hit.place")
    # one row for each way in which an item lies over a run
    ways = hits.join(found, "hash").groupBy("doc_id", "run", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).agg(F.array_sort(F.collect_set("item_place")).alias("hits"))
    laid = ways.join(runs.select("doc_id", "run", "begin", "tokens"), ["doc_id", "run"]).join(items, "item_id")
    laid = laid.select("doc_id", "item_id", "begin", "tokens", "item", "shift", "hits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, item_id, begin, a, b, shift, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.array(a), np.array(b)
                end = -1
                for place in hits:
                    # from a hit inside a stretch the same stretch or a part of it is found
                    if place < end:
                        continue
                    start, end, equal = overlap(a, b, shift, place)
                    out.append((doc_id, item_id, equal.tolist(), len(b), begin + start + shift, begin + end + shift))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "item_id", "equal", "item_tokens", "first", "last"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, item_id long, equal array<long>, item_tokens long, first long, last long"
    matched = F.size(F.array_distinct(F.flatten(F.collect_set("equal")))).cast("long")
    return (
        laid.mapInArrow(compare, schema)
        .groupBy("doc_id", "item_id", "item_tokens")
        .agg(matched.alias("matched_tokens"), F.min("first").alias("first_token"), (F.max("last") - 1).alias("last_token"))
        .withColumn("coverage", F.col("matched_tokens") / F.col("item_tokens"))
        .filter((F.col("matched_tokens") >= F.least(F.lit(least_tokens), "item_tokens")) & (F.col("coverage") >= least_share))
        .select("doc_id", "item_id", "matched_tokens", "item_tokens", "coverage", "first_token", "last_token")
    )


def _items(benchmark: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [tokens(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, type=pa.list_(pa.int64()))], ["item_id", "item"])

    columns = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return columns.distinct().mapInArrow(run, "item_id long, item array<long>")


def _seed_rows(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, item in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                value, place = seeds(np.array(item, dtype=np.int64).view(np.uint64))
                ids = pa.array([item_id.as_py()] * len(value), type=pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), ids, pa.array(place)], ["hash", "item_id", "item_place"])

    return items.mapInArrow(run, "hash long, item_id long, item_place long")


def _bit_map(found: DataFrame) -> np.ndarray:
    """2**24 bits, of which each seed hash sets one; Spark folds them into at most 2**18 words."""
    slot = F.col("hash").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = found.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _runs(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """Stretches of documents around seeds that the benchmark may have, with their hits."""
    longest = max(len(m) for m in MASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = tokens(text.as_py())
                value, place = seeds(words)
                hit = known[value & np.uint64((1 << MAP_BITS) - 1)]
                if not hit.any():
                    continue
                order = np.argsort(place[hit], kind="stable")
                value, place = value[hit][order], place[hit][order]
                cuts = np.flatnonzero(np.diff(place) > REACH) + 1
                for number, (v, p) in enumerate(zip(np.split(value, cuts), np.split(place, cuts), strict=True)):
                    begin = max(0, int(p[0]) - REACH)
                    part = words[begin : p[-1] + longest + REACH]
                    out.append((doc_id, number, begin, part.view(np.int64), v.view(np.int64), p - begin))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            many = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.int32(), pa.int64(), many, many, many]
            names = ["doc_id", "run", "begin", "tokens", "hash", "place"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, run int, begin long, tokens array<long>, hash array<long>, place array<long>"
    return id_and_text(docs).mapInArrow(run, schema)
