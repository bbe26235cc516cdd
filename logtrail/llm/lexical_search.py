"""Ranked lexical search by the Best Position Algorithm.

Documents are indexed by the terms that queries have, found with a bit map of fixed
size. A task reads the index in shards of bounded size and has, per term, the list of the
shard's documents by falling impact. For a query all its lists are read in
parallel; each document met is looked up in every list at once, which gives its whole
score and marks its places. The best position of a list is the last place before the first
unmarked one (Akbarinia, Pacitti and Valduriez, 2007). No document not met scores more than the sum of
the impacts at the best positions, so reading stops once that is strictly below the
k-th score; at equality it goes on, as ties are ranked by number. The k-th score of the
shards a task has done is the starting bound for its next one.

Impacts and scores are 64-bit integers; only the weight of a term uses doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtrail.llm import hashing
from logtrail.llm.tables import id_and_text, stage

MAP_BITS = 24
#: Postings of a shard, about; a batch of documents is never split.
SHARD_POSTINGS = 1 << 20
#: Pairs of query and term that are searched for in one pass over the index.
BLOCK_TERMS = 500_000
_NO_ID = np.iinfo(np.int64).max


def _term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    words = hashing.words((text or "").encode(), hashing.NO_WORD)
    terms, counts = np.unique(words, return_counts=True)
    return terms, counts, len(words)


def _listed(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat.astype(np.int64, copy=False), type=kind))


def query_terms(items: DataFrame) -> DataFrame:
    """``item_key, item_id, terms, counts`` of every query row with a term; the key tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_term_counts(t.as_py()) for t in batch.column(1)]
            columns = [_listed([f[k].view(np.int64) for f in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["item_id", "terms", "counts"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "item_id long, terms array<long>, counts array<long>").filter(F.size("terms") > 0)
    return found.select(F.monotonically_increasing_id().alias("item_key"), "item_id", "terms", "counts")


def _bit_map(queries: DataFrame) -> np.ndarray:
    """2**24 bits, of which each query term sets one; Spark folds them into at most 2**18 words."""
    slot = F.col("term").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = queries.select(F.explode("terms").alias("term")).select(
        F.shiftright(slot, 6).alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"),
    )
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def index(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``doc_id, n, terms, counts`` of every document with a term; of its terms, those a query may have."""
    bits = _bit_map(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bits, bitorder="little").view(bool)
        for batch in batches:
            found = []
            for text in batch.column(1):
                terms, counts, n = _term_counts(text.as_py())
                hit = known[terms & np.uint64((1 << MAP_BITS) - 1)]
                found.append((terms[hit].view(np.int64), counts[hit], n))
            n = pa.array([f[2] for f in found], type=pa.int64())
            columns = [_listed([f[k] for f in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), n, *columns], ["doc_id", "n", "terms", "counts"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n long, terms array<long>, counts array<long>").filter("n > 0")


def term_weights(indexed: DataFrame, queries: DataFrame, documents: int) -> DataFrame:
    """``term, weight`` of every query term that a document holds."""
    held = indexed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.select(F.explode("terms").alias("term")).distinct()
    weight = F.floor(F.lit(1000.0) * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    return held.join(asked, "term").select("term", weight.cast("long").alias("weight")).filter("weight > 0")


@dataclass(frozen=True)
class Queries:
    """A block of queries: known terms with weights, and each query's terms as positions among them."""

    keys: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray
    term_no: np.ndarray
    counts: np.ndarray


class Shard:
    """Impact lists over one shard: per term by falling impact, with the place of each document in them."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int, ids: np.ndarray):
        order = np.lexsort((docs, -impacts, terms))
        self.docs, self.impacts, self.ids, self.size = docs[order], impacts[order], ids, len(ids)
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        keys = terms[order] * self.size + self.docs
        self.place = np.argsort(keys, kind="stable")
        self.keys = keys[self.place]

    def search(self, terms: np.ndarray, counts: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of this shard and of the given ``scores`` and ``ids``, higher score and then lower number first."""
        starts = self.starts[terms]
        lengths = self.starts[terms + 1] - starts
        some = lengths > 0
        terms, counts, starts, lengths = terms[some], counts[some], starts[some], lengths[some]
        bases = np.concatenate(([0], np.cumsum(lengths)))
        seen = np.zeros(bases[-1], dtype=bool)
        met = np.zeros(self.size, dtype=bool)
        best = np.zeros(len(terms), dtype=np.int64)
        depth, step = 0, 16
        while len(terms):
            rows = [self.docs[s + depth : s + min(n, depth + step)] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
            docs = np.unique(np.concatenate(rows))
            docs = docs[~met[docs]]
            if len(docs):
                met[docs] = True
                wanted = terms[:, None] * self.size + docs[None, :]
                at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                there = self.keys[at] == wanted
                place = self.place[at]
                found = counts @ np.where(there, self.impacts[place], 0)
                lists, _ = np.nonzero(there)
                seen[bases[lists] + place[there] - starts[lists]] = True
                scores, ids = _best(np.concatenate((scores, found)), np.concatenate((ids, self.ids[docs])), k)
            bound = 0
            for i, (base, n) in enumerate(zip(bases.tolist(), lengths.tolist(), strict=False)):
                rest = seen[base + best[i] : base + n]
                gap = int(rest.argmin()) if len(rest) else 0
                best[i] += len(rest) if len(rest) == 0 or rest[gap] else gap
                if best[i] < n:
                    bound += int(counts[i]) * int(self.impacts[starts[i] + best[i] - 1])
            # strictly: at equality a document not met could tie and have a lower number
            if bound == 0 or (len(scores) == k and bound < scores[-1]):
                break
            depth, step = depth + step, min(2 * step, 4096)
        return scores, ids


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _block(queries: DataFrame, weights: DataFrame) -> Queries:
    each = queries.select("item_key", F.inline(F.arrays_zip("terms", "counts"))).withColumnRenamed("terms", "term")
    got = each.join(weights, "term").toArrow()
    key, term, count, weight = (got.column(c).to_numpy() for c in ("item_key", "term", "counts", "weight"))
    order = np.argsort(key, kind="stable")
    key, term, count, weight = key[order], term[order].view(np.uint64), count[order], weight[order]
    keys, first = np.unique(key, return_index=True)
    terms, at, term_no = np.unique(term, return_index=True, return_inverse=True)
    return Queries(keys, terms, weight[at], np.append(first, len(key)), term_no, count)


def _search(indexed: DataFrame, queries: Queries, k: int, documents: int, tokens: int) -> DataFrame:
    def shard(docs: list[np.ndarray], n: list[np.ndarray], sizes: list[np.ndarray], terms: list[np.ndarray], counts: list[np.ndarray]) -> Shard:
        ids, lengths, term, tf = np.concatenate(docs), np.concatenate(n), np.concatenate(terms).view(np.uint64), np.concatenate(counts)
        doc = np.repeat(np.arange(len(ids)), np.concatenate(sizes))
        no = np.minimum(np.searchsorted(queries.terms, term), len(queries.terms) - 1)
        known = queries.terms[no] == term
        doc, no, tf = doc[known], no[known], tf[known]
        m = 75 + (25 * lengths[doc] * documents) // tokens
        impact = queries.weights[no] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
        some = impact > 0
        return Shard(no[some], doc[some], impact[some], len(queries.terms), ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.empty(0, np.int64)
        best = [(nothing, nothing)] * len(queries.keys)

        def search(parts: list) -> None:
            found = shard(*zip(*parts, strict=True))
            for q in range(len(best)):
                mine = slice(queries.bounds[q], queries.bounds[q + 1])
                best[q] = found.search(queries.term_no[mine], queries.counts[mine], k, *best[q])

        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                terms, counts = batch.column(2), batch.column(3)
                ids = batch.column(0).fill_null(_NO_ID).to_numpy()
                parts.append((ids, batch.column(1).to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), counts.flatten().to_numpy()))
                held += len(parts[-1][3])
            if held > SHARD_POSTINGS:
                search(parts)
                parts, held = [], 0
        if parts:
            search(parts)
        sizes = [len(s) for s, _ in best]
        scores, ids = (np.concatenate([nothing, *(b[i] for b in best)]) for i in (0, 1))
        keys = np.repeat(queries.keys, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], ["item_key", "doc_id", "score"])

    return indexed.mapInArrow(run, "item_key long, doc_id long, score long").filter("score > 0")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents of every query: ``item_id, rank, doc_id, score``.

    ``items`` has ``item_id, text``; each of its rows is a query, also if a number repeats
    or is null. Equal scores are ranked by number, null numbers last; each row of ``docs`` is a
    document, so repeated ones may follow each other with one score. Texts without a
    term, null and empty ones neither match nor count; empty tables give no rows. Other columns are not
    read. Queries are searched for in blocks of about ``BLOCK_TERMS`` terms.
    """
    spark = docs.sparkSession
    queries = stage(query_terms(items), "search-queries")
    indexed = stage(index(docs, queries), "search-index")
    documents, tokens = indexed.agg(F.count("*"), F.sum("n")).first()
    asked = queries.agg(F.sum(F.size("terms"))).first()[0]
    schema = "item_key long, doc_id long, score long"
    found = spark.createDataFrame([], schema)
    if documents and asked:
        weights = stage(term_weights(indexed, queries, documents), "search-weights")
        blocks = -(-asked // BLOCK_TERMS)
        for block in range(blocks):
            mine = _block(queries.filter(F.pmod(F.xxhash64("item_key"), F.lit(blocks)) == block), weights)
            if len(mine.terms):
                found = found.union(_search(indexed, mine, k, documents, tokens))
    ranked = Window.partitionBy("item_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return top.join(queries.select("item_key", "item_id"), "item_key").select("item_id", "rank", "doc_id", "score")
