"""Language identification by bit-sliced Bloom filters.

Each language has the character n-grams that are about as frequent in it as in any
language. All languages share one Bloom filter table that is sliced by bits: a slot
holds a bit mask of languages, and an n-gram's slots combined by AND are the languages
that contain it, one look-up for all. A text's votes for a language are the n-grams that
have its bit, less those that the filter's filling makes appear by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtrail.llm import hashing
from logtrail.llm.tables import id_and_text

SIZES = (3, 4)
SLOT_BITS = 21
HASHES = 2
#: Languages in one mask word.
_WORD = 63

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True


def grams(text: str) -> np.ndarray:
    """The byte n-grams of the lower-cased letters, one space between words and at the ends; numbers below 2**32."""
    data = np.frombuffer(f" {text.lower()} ".encode(errors="replace"), dtype=np.uint8)
    letter = _LETTER[data]
    keep = letter | np.concatenate(([True], letter[:-1]))
    line = np.where(letter, data, 32)[keep].astype(np.uint32)
    out = []
    for size in SIZES:
        n = len(line) - size + 1
        if n > 0:
            value = np.zeros(n, dtype=np.uint32)
            for k in range(size):
                value = value << np.uint32(8) | line[k : k + n]
            out.append(value)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def slots(values: np.ndarray) -> list[np.ndarray]:
    """The places of n-grams in the table, one array per hash."""
    mixed = hashing.mix(values.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return [(mixed >> np.uint64(32 * k)).astype(np.int64) & ((1 << SLOT_BITS) - 1) for k in range(HASHES)]


@dataclass(frozen=True)
class Filters:
    """Names of the languages, most frequent first, the sliced table, and each language's rate of false positives."""

    languages: list[str]
    table: np.ndarray
    chance: np.ndarray

    def votes(self, text: str) -> np.ndarray:
        """Share of the text's n-grams in each language, corrected for chance."""
        values = grams(text)
        out = np.zeros(len(self.languages))
        if not len(values):
            return out
        places = slots(values)
        for word, table in enumerate(self.table):
            mask = table[places[0]]
            for other in places[1:]:
                mask = mask & table[other]
            for bit in range(min(_WORD, len(out) - word * _WORD)):
                out[word * _WORD + bit] = np.count_nonzero(mask & (1 << bit))
        return np.maximum(0, (out / len(values) - self.chance) / (1 - self.chance))


def fit(labelled: DataFrame, least_rate: float = 2e-6, share_of_best: float = 0.2) -> Filters:
    """Filters from rows ``text, lang``; rows without a language are left out.

    An n-gram belongs to a language if its rate there is at least ``share_of_best`` of its
    highest rate in any, and ``least_rate``; so a language has at most 1 / least_rate
    n-grams of each size, and the table, which comes to the driver as its filled slots,
    has a size that does not depend on the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = batch.column(1)
            for lang in set(langs):
                found = [grams(texts[k].as_py() or "") for k, value in enumerate(langs) if value == lang]
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), type=pa.string()), pa.array(values.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes, key=lambda k: (-sizes[k], k))
    table = np.zeros((max(1, -(-len(languages) // _WORD)), 1 << SLOT_BITS), dtype=np.int64)
    if not languages:
        return Filters([], table, np.zeros(0))
    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counted.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = F.max("rate").over(Window.partitionBy("gram"))
    chosen = rated.withColumn("best", best).filter((F.col("rate") >= share_of_best * F.col("best")) & (F.col("rate") >= least_rate))
    number = {lang: k for k, lang in enumerate(languages)}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.array([number[v] for v in batch.column(0).to_pylist()], dtype=np.int64)
            for slot in slots(batch.column(1).to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array((k // _WORD).astype(np.int32)), pa.array(slot), pa.array(np.int64(1) << (k % _WORD))], ["word", "slot", "bit"])

    folded = chosen.select("lang", "gram").mapInArrow(places, "word int, slot long, bit long").groupBy("word", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    table[folded.column("word").to_numpy(), folded.column("slot").to_numpy()] = folded.column("bits").to_numpy()
    filled = [np.count_nonzero(table[k // _WORD] & (1 << (k % _WORD))) / (1 << SLOT_BITS) for k in range(len(languages))]
    return Filters(languages, table, np.array(filled) ** HASHES)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """``doc_id, lang_pred, score`` per row of ``docs``; the score is the language's share of the votes.

    ``und`` with score 0 for null texts, texts without a letter, or when no language was
    learned. A text whose n-grams no language knows gets the most frequent language with
    score 0; equal votes go to the more frequent one. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for value in batch.column(1):
                text = value.as_py()
                if not text or not model.languages or not any(map(str.isalpha, text)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                votes = model.votes(text)
                names.append(model.languages[int(votes.argmax())])
                scores.append(float(votes.max() / votes.sum()) if votes.any() else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, type=pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
