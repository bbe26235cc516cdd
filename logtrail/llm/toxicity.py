"""Toxic passages by maximum-scoring segments.

Every word has a weight: the log-odds between toxic and clean labelled documents, under a
Dirichlet prior, of the longest unit of it that was seen often enough (the word itself, else a prefix),
if the evidence passes a threshold that grows with the number of units; all other words
cost a little. One scan per document finds all maximal scoring segments (Ruzzo and
Tompa, 1999) in linear time. How surprising a segment is follows from extreme-value
statistics (Karlin and Altschul, 1990): in clean text of n words about
``K n exp(-rate S)`` segments score S or more. ``rate`` solves its equation over the
weights of clean words, ``K`` is fitted on the clean documents' best segments, and the
segments of a document are taken together by the sum statistics of the same theory.

A word between the same neighbours counts once per label, so a group of copies, or a
passage that many documents share, does not make its words look toxic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtrail.llm import hashing
from logtrail.llm.tables import id_and_text, stage

#: Prefixes of a word that have counts of their own, in bytes.
PREFIXES = (9, 8, 7, 6, 5, 4)
#: Occurrences a unit needs before its own counts are used.
LEAST_SEEN = 5
#: How much more frequent a unit with a weight must be in toxic documents.
LEAST_RATIO = 3.0

_FLUSH = 1 << 20
SEGMENT = "array<struct<first_word:long,last_word:long,start:long,end:long,weight:double,passage:string>>"


@dataclass(frozen=True)
class Weights:
    """Known units by fingerprint, in order, with the weight of a word for which it is the longest; what any other word costs."""

    units: np.ndarray
    weights: np.ndarray
    cost: float
    rate: float = 1.0

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of the words of a text, and the words' bounds."""
        units, starts, ends = hashing.word_prefixes(text, PREFIXES, self.units)
        out = np.full(len(starts), -self.cost)
        left = np.flatnonzero(units[0])
        for row in units:
            known = hashing.among(self.units, row[left])
            found = left[known]
            out[found] = self.weights[np.searchsorted(self.units, row[found])]
            left = left[~known]
        return out, starts, ends


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last, sum), in one pass over the positive weights.

    Each kept segment knows the nearest earlier one whose sum before it is lower, so the
    search for the one to join with never looks at a segment twice.
    """
    total = np.cumsum(weights)
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum at the end, first, last, link
    for k in np.flatnonzero(weights > 0).tolist():
        before, after, first = (float(total[k - 1]) if k else 0.0), float(total[k]), k
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= before:
                j = found[j][4]
            if j < 0 or found[j][1] >= after:
                found.append((before, after, first, k, j))
                break
            before, first = found[j][0], found[j][2]
            del found[j:]
    return [(first, last, after - before) for before, after, first, last, _ in found]


def labelled(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """``text, toxic`` of labelled documents; of more than ``most_rows``, an even draw by number.

    The labels that are left, two numbers each, are bounded by ``most_rows`` and sent to the documents.
    """
    given = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = given.count()
    if rows > most_rows:
        given = given.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most_rows / rows))
    return id_and_text(docs).join(F.broadcast(given), "doc_id").select("text", "toxic")


def _unit_counts(rows: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """``unit, clean, toxic``: words of each label with a unit, once per document; of all units or of known ones.

    Unit 0 has the number of words, repeats included. Tasks add up before the shuffle.
    """

    def flush(kept: list) -> pa.RecordBatch:
        units, place = np.unique(np.concatenate([u for u, _ in kept]), return_inverse=True)
        toxic = np.concatenate([np.full(len(u), t) for u, t in kept])
        counts = [np.bincount(place[toxic == label], minlength=len(units)).astype(np.int64) for label in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(units.view(np.int64)), *map(pa.array, counts)], ["unit", "clean", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                units = hashing.word_prefixes((text.as_py() or "").encode(), PREFIXES, known)[0]
                n = units.shape[1]
                units = units[:, np.unique(units[0], return_index=True)[1]]
                some = units[units != 0]
                some = some if known is None else some[hashing.among(known, some)]
                kept.append((np.concatenate((some, np.zeros(n, np.uint64))), toxic))
                held += len(kept[-1][0])
                if held > _FLUSH:
                    yield flush(kept)
                    kept, held = [], 0
        if kept:
            yield flush(kept)

    counted = rows.mapInArrow(run, "unit long, clean long, toxic long")
    return counted.groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _independent_counts(rows: DataFrame, likely: np.ndarray) -> DataFrame:
    """``unit, clean, toxic`` over words that have a likely unit; a word between the same neighbours counts once per label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.empty((0, len(PREFIXES) + 3), dtype=np.uint64)]
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                units = hashing.word_prefixes((text.as_py() or "").encode(), PREFIXES)[0]
                hit = np.flatnonzero(hashing.among(likely, units).any(axis=0))
                if len(hit):
                    edge = np.concatenate((np.zeros(1, np.uint64), units[0], np.zeros(1, np.uint64)))
                    around = hashing.mix(hashing.mix(edge[hit]) + edge[hit + 2])
                    out.append(np.column_stack([around, np.full(len(hit), toxic, np.uint64), units[:, hit].T]))
            rows = np.concatenate(out).view(np.int64)
            units = pa.FixedSizeListArray.from_arrays(pa.array(rows[:, 2:].ravel()), len(PREFIXES) + 1).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), units], ["around", "label", "units"])

    seen = rows.mapInArrow(run, "around long, label long, units array<long>")
    once = seen.groupBy("around", "label", F.col("units")[0].alias("word")).agg(F.first("units").alias("units"))
    each = once.select("label", F.explode("units").alias("unit")).filter("unit <> 0")
    return each.groupBy("unit").agg(F.count_if(F.col("label") == 0).alias("clean"), F.count_if(F.col("label") == 1).alias("toxic"))


def _evidence(clean: np.ndarray, toxic: np.ndarray, all_clean: float, all_toxic: float) -> np.ndarray:
    """Twice the log-likelihood ratio of a unit's split between the labels against that of all words; 0 if it is not more toxic."""
    expected = (clean + toxic) * all_toxic / (all_clean + all_toxic)
    others = np.maximum(clean + toxic - expected, 1e-300)
    parts = toxic * np.log(np.maximum(toxic, 1e-300) / np.maximum(expected, 1e-300)) + clean * np.log(np.maximum(clean, 1e-300) / others)
    return np.where(toxic > expected, 2 * parts, 0.0)


def _arrays(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = counts.toArrow()
    units = got.column("unit").to_numpy().view(np.uint64)
    order = np.argsort(units)
    return units[order], *(got.column(c).to_numpy()[order].astype(float) for c in ("clean", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, prior: float = 1000.0, cost: float = 0.2, most_rows: int = 500_000) -> Weights:
    """Weights from documents and ``labels`` (``doc_id, toxic`` 0/1; other values and nulls are left out).

    At most ``most_rows`` labelled rows are read, drawn evenly by number; this bounds the units
    that reach the driver, each of which toxic documents hold ``LEAST_SEEN`` times. A unit has a weight if
    it is ``LEAST_RATIO`` times as frequent in toxic documents and its evidence exceeds twice
    the log of the number of units. ``prior`` is the number of words that the Dirichlet
    prior is worth. Without rows of both labels no word has a weight.
    """
    rows = stage(labelled(docs, labels, most_rows), "toxic-rows")
    nothing = Weights(np.empty(0, np.uint64), np.empty(0), cost)
    units = _arrays(_unit_counts(rows.filter("toxic = 1")).filter(F.col("toxic") >= LEAST_SEEN))[0]
    if not len(units):
        return nothing
    units, y0, y1 = _arrays(_unit_counts(rows, units))
    totals = dict(zip(units.tolist(), zip(y0.tolist(), y1.tolist(), strict=True), strict=True)).get(0)
    if not totals or not all(totals):
        return nothing
    needed = 2 * np.log(len(units) + 1)
    # repeats and copies only blur the ratio, so half of what is needed chooses the words that are looked at closely
    often = y1 * totals[0] >= LEAST_RATIO / 2 * y0 * totals[1]
    likely = units[(units != 0) & often & (_evidence(y0, y1, *totals) >= needed)]
    units, y0, y1 = _arrays(_independent_counts(rows, likely).filter(F.col("clean") + F.col("toxic") >= LEAST_SEEN))
    mass = 0.5 + prior * (y0 + y1) / sum(totals)
    odds = [np.log((y + mass) / (n + prior - y)) for y, n in ((y0, totals[0]), (y1, totals[1]))]
    good = (_evidence(y0, y1, *totals) >= needed) & (odds[1] - odds[0] >= np.log(LEAST_RATIO))
    model = Weights(units, np.where(good, odds[1] - odds[0], -cost), cost)
    return Weights(units, model.weights, cost, _rate(*_clean_weights(rows.filter("toxic = 0"), model), cost))


def _clean_weights(rows: DataFrame, model: Weights) -> tuple[np.ndarray, np.ndarray]:
    """The weights, to a hundredth, of the words of clean documents, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0)]
            for text in batch.column(0):
                found.append(model.of((text.as_py() or "").encode())[0])
            values, counts = np.unique(np.round(np.concatenate(found) * 100).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["weight", "n"])

    got = rows.select("text").mapInArrow(run, "weight long, n long").groupBy("weight").agg(F.sum("n").alias("n")).toArrow()
    return got.column("weight").to_numpy() / 100, got.column("n").to_numpy().astype(float)


def _rate(weights: np.ndarray, counts: np.ndarray, cost: float) -> float:
    """The positive number for which the mean of exp(rate x weight) over clean words is one.

    A twentieth is added to the counts of the weights 1 to 10, so that the number exists.
    """
    grid = np.arange(1, 11)
    weights, counts = np.concatenate((weights, grid, [-cost])), np.concatenate((counts, np.full(10, 0.05), [1.0]))
    share = counts / counts.sum()
    low, high = 0.0, 1.0
    while high < 16 and share @ np.exp(high * weights) < 1:
        low, high = high, 2 * high
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if share @ np.exp(middle * weights) < 1 else (low, middle)
    return high


def scan(docs: DataFrame, model: Weights) -> DataFrame:
    """``doc_id, n_words, segments`` per row; a segment has its words, bytes, weight and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], []
            for value in batch.column(1):
                text = (value.as_py() or "").encode()
                weights, starts, ends = model.of(text)
                n.append(len(starts))
                found.append(
                    [
                        {"first_word": a, "last_word": b, "start": int(starts[a]), "end": int(ends[b]), "weight": w, "passage": text[starts[a] : ends[b]].decode()}
                        for a, b, w in segments(weights)
                    ]
                )
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("first_word", "last_word", "start", "end")] + [("weight", pa.float64()), ("passage", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, type=pa.int64()), pa.array(found, type=kind)], ["doc_id", "n_words", "segments"])

    return id_and_text(docs).mapInArrow(run, f"doc_id long, n_words long, segments {SEGMENT}")


def chance_factor(scanned: DataFrame, labels: DataFrame, model: Weights) -> float:
    """``K``: with it, the expected number of segments like a clean document's best one is one on average."""
    clean = labels.filter("toxic = 0").select(F.col("doc_id").cast("long").alias("doc_id"))
    best = F.coalesce(F.array_max(F.col("segments.weight")), F.lit(0.0))
    chances = scanned.filter("n_words > 0").select("doc_id", (F.col("n_words") * F.exp(-model.rate * best)).alias("chance"))
    mean = chances.join(clean, "doc_id").agg(F.avg("chance")).first()[0]
    return 1 / mean if mean else 1.0


def _surprise(model: Weights, k: float) -> Column:
    """Minus the log of the chance that clean text of this length holds segments as good as the best r, for the best r."""
    floor = F.log(F.lit(k) * F.col("n_words"))
    scaled = F.transform(F.sort_array(F.col("segments.weight"), asc=False), lambda w: w * model.rate - floor)
    start = F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("logs"), F.lit(0.0).alias("best"))

    def add(a: Column, s: Column) -> Column:
        r, total = a["r"] + 1, a["sum"] + s
        logs = a["logs"] + F.log(r) + F.log(F.greatest(r - 1, F.lit(1.0)))
        chance = F.when(total > 0, total - (r - 1) * F.log(total) + logs - (r - 1) * math.log(2)).otherwise(0.0)
        return F.struct(r.alias("r"), total.alias("sum"), logs.alias("logs"), F.greatest(a["best"], chance).alias("best"))

    return F.aggregate(scaled, start, add, lambda a: a["best"])


def passages(scanned: DataFrame, model: Weights, k: float, level: float = 0.002) -> DataFrame:
    """The significant passages: ``doc_id, first_word, last_word, start, end, weight, expected, passage``.

    ``expected`` is how many segments of this weight a clean text of this length holds;
    a passage is significant if that is at most ``level``. ``start`` and ``end`` are bytes.
    """
    each = scanned.select("doc_id", "n_words", F.inline("segments"))
    expected = F.lit(k) * F.col("n_words") * F.exp(-model.rate * F.col("weight"))
    columns = ["doc_id", "first_word", "last_word", "start", "end", "weight", "expected", "passage"]
    return each.withColumn("expected", expected).filter(F.col("expected") <= level).select(*columns)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, level: float = 0.002, **fitting: float) -> DataFrame:
    """``doc_id, score, predicted, n_words, n_passages, toxic_words`` per row of ``docs``.

    ``labels`` has ``doc_id, toxic``; rows to hold out are left out by the caller. The score
    is one half where a document's segments are as surprising as ``level`` and grows with
    their surprise; null, empty and wordless texts have no segment and the lowest score.
    Repeated rows are scored each; a null number belongs to no label. Without labels of
    both kinds all have the lowest score; an empty table gives no rows. Other columns are not read.
    """
    model = fit(docs, labels, **fitting)
    scanned = stage(scan(docs, model), "toxic-segments")
    k = chance_factor(scanned, labels, model)
    z = F.when(F.size("segments") > 0, _surprise(model, k)).otherwise(0.0) + math.log(level)
    significant = F.filter("segments", lambda s: F.lit(k) * F.col("n_words") * F.exp(-model.rate * s["weight"]) <= level)
    return (
        scanned.select("doc_id", "n_words", "segments", z.alias("_z"), significant.alias("_found"))
        .withColumn("score", 0.5 + 0.5 * F.col("_z") / (1 + F.abs("_z")))
        .select(
            "doc_id",
            "score",
            (F.col("score") >= threshold).cast("int").alias("predicted"),
            "n_words",
            F.size("_found").cast("long").alias("n_passages"),
            F.aggregate("_found", F.lit(0).cast("long"), lambda a, s: a + s["last_word"] - s["first_word"] + 1).alias("toxic_words"),
        )
    )
