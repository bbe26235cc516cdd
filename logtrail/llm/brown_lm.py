"""Language-model scores of Brown classes.

Words fall into classes by exchange: a word moves to the class that raises the
likelihood of class bigrams most. Words above a rate in the corpus move alone; all
others move with the words of their ending, since a word seen twice says little about
where it belongs and an unseen one nothing. The rate bounds the number of movers, so
the statistics of one exchange round (movers x classes) have a fixed size, and each
round is a Spark aggregation over the movers' bigrams.

A text's probability is the product over its words and its end of the class transition
(add-alpha) and of the word's emission: mover given class (add-beta), and word given
ending by absolute discounting; what the discount frees is the probability of an
unseen word of that ending. So all words of a class, seen or not, sum to one.

Counts of all words stay distributed. Documents are dealt into blocks by number, a
block asks for its words' counts in a join, and is scored with the answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrail.llm import hashing
from logtrail.llm.tables import id_and_text, stage

#: Words of at least this share of the tokens move between classes on their own: 10,000 at most.
LEAST_RATE = 1e-4
ENDINGS = 1024
BLOCK_BYTES = 8 << 20
_END = np.uint64(0x6A09E667F3BCC909)


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and endings of a text's words (A-Z lower-cased), then those of the end."""
    data = np.frombuffer(text.lower(), dtype=np.uint8)
    starts, ends = hashing.word_bounds(data)
    sums = hashing.prefix_sums(data)
    words = hashing.spans(sums, starts, ends)
    endings = (hashing.spans(sums, np.maximum(starts, ends - 3), ends) % np.uint64(ENDINGS)).astype(np.int64)
    return np.append(words, _END), np.append(endings, ENDINGS)


def _batch_tokens(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    return [tokens(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, ending, n``: hash, ending and count of every word and of the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words, endings = (np.concatenate(c) for c in zip(*_batch_tokens(batch), strict=True))
                words, first, counts = np.unique(words, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(endings[first].astype(np.int32)), pa.array(counts)], ["word", "ending", "n"])

    found = id_and_text(docs).mapInArrow(run, "word long, ending int, n long")
    return found.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class Movers:
    """Frequent words (sorted hashes, counts); movers are these, then the endings, then the end."""

    words: np.ndarray
    counts: np.ndarray

    @property
    def size(self) -> int:
        return len(self.words) + ENDINGS + 1

    def of(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """The mover of each token."""
        if not len(self.words):
            return endings.copy()
        place = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[place] == words, place, len(self.words) + endings)


def bigrams(docs: DataFrame, movers: Movers) -> DataFrame:
    """``a, b, n``: how often mover ``b`` follows ``a``; a text begins after an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                line = np.concatenate([movers.of(*t) for t in _batch_tokens(batch)])
                before = np.concatenate(([movers.size - 1], line[:-1]))
                pairs, counts = np.unique(before * movers.size + line, return_counts=True)
                a, b = np.divmod(pairs, movers.size)
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts)], ["a", "b", "n"])

    return id_and_text(docs).mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _contexts(pairs: DataFrame, classes: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """For every mover how often each class stands before it, and after it."""
    size = len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size * number), dtype=np.int64)
        for batch in batches:
            a, b, n = (c.to_numpy() for c in batch.columns)
            total[0] += np.bincount(b * np.int64(number) + classes[a], weights=n, minlength=size * number).astype(np.int64)
            total[1] += np.bincount(a * np.int64(number) + classes[b], weights=n, minlength=size * number).astype(np.int64)
        side, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(side.astype(np.int32)), pa.array(cell), pa.array(total[side, cell])], ["side", "cell", "n"])

    got = pairs.mapInArrow(run, "side int, cell long, n long").groupBy("side", "cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, size * number))
    out[got.column("side").to_numpy(), got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out[0].reshape(size, number), out[1].reshape(size, number)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: DataFrame, size: int, number: int = 48, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the movers, and the counts of class bigrams; the end has the last class to itself.

    In each round half of the movers, by turns, go where the likelihood gains most.
    Contexts are counted by Spark; deciding takes movers x classes numbers.
    """
    classes = np.arange(size) % number
    classes[-1] = number
    before, after = _contexts(pairs, classes, number + 1)
    seen = before.sum(axis=1)
    order = np.argsort(-seen[:-1], kind="stable")
    classes[order] = np.arange(size - 1) % number
    for turn in range(rounds):
        before, after = _contexts(pairs, classes, number + 1)
        table = np.zeros((number + 1, number + 1))
        np.add.at(table, classes, after)
        left, right = after.sum(axis=1), before.sum(axis=1)
        rows, columns = table.sum(axis=1), table.sum(axis=0)
        gain = np.empty((size, number))
        own = classes[:, None] == np.arange(number)
        for c in range(number):
            # what the mover adds to the class; from its own class it is taken out first
            out = own[:, c, None]
            into, outof = table[None, :, c], table[None, c, :]
            into_low, outof_low = np.where(out, np.maximum(into - before, 0), into), np.where(out, np.maximum(outof - after, 0), outof)
            row_low, column_low = np.where(out[:, 0], rows[c] - left, rows[c]), np.where(out[:, 0], columns[c] - right, columns[c])
            gain[:, c] = (_xlogx(into_low + before) - _xlogx(into_low)).sum(axis=1) + (_xlogx(outof_low + after) - _xlogx(outof_low)).sum(axis=1)
            gain[:, c] -= _xlogx(row_low + left) - _xlogx(row_low) + _xlogx(column_low + right) - _xlogx(column_low)
        best = gain.argmax(axis=1)
        better = gain.max(axis=1) > gain[np.arange(size), np.minimum(classes, number - 1)] + 1e-9
        moves = better & (np.arange(size) % 2 == turn % 2) & (seen > 0)
        moves[-1] = False
        classes[moves] = best[moves]
    _, after = _contexts(pairs, classes, number + 1)
    table = np.zeros((number + 1, number + 1))
    np.add.at(table, classes, after)
    return classes, table


@dataclass(frozen=True)
class Model:
    """All of the model whose size is fixed: movers, classes, their logarithms, and the totals of the corpus."""

    movers: Movers
    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    seen: np.ndarray
    distinct: np.ndarray
    discount: float
    total: int
    vocabulary: int

    def scores(self, words: np.ndarray, endings: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
        """log10 of the text's probability in the unigram base and in the model, by the training counts of its words."""
        base = np.log10((counts + 0.1) / (self.total + 0.1 * (self.vocabulary + 1))).sum()
        mover = self.movers.of(words, endings)
        at = self.classes[mover]
        log = self.transition[np.concatenate(([self.classes[-1]], at[:-1])), at] + self.emission[mover]
        rare = (mover >= len(self.movers.words)) & (mover < self.movers.size - 1)
        ending, n = endings[rare], counts[rare]
        seen = np.maximum(self.seen[ending], 1)
        # what the discount frees goes to unseen words; an ending without any word is unseen itself
        unseen = np.where(self.seen[ending] > 0, np.maximum(self.discount * self.distinct[ending], 1e-3) / seen, 1.0)
        within = np.where(n > 0, np.maximum(n - self.discount, 1e-3) / seen, unseen)
        return float(base), float(log.sum() + np.log10(within).sum())


def fit(training: DataFrame, counts: DataFrame, classes: int = 48, rounds: int = 10, alpha: float = 0.1, beta: float = 0.1) -> Model:
    """A model of the training documents, whose ``word_counts`` are given."""
    sums = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("*").alias("vocabulary"),
        F.count_if(F.col("n") == 1).alias("once"),
        F.count_if(F.col("n") == 2).alias("twice"),
    ).first()
    frequent = counts.filter((F.col("n") >= max(2.0, LEAST_RATE * sums.total)) & (F.col("ending") < ENDINGS)).select("word", "n").toArrow()
    words = frequent.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    movers = Movers(words[order], frequent.column("n").to_numpy()[order])
    rare = counts.join(F.broadcast(counts.sparkSession.createDataFrame(pa.table({"word": movers.words.view(np.int64)}))), "word", "left_anti")
    seen, distinct = np.zeros(ENDINGS + 1), np.zeros(ENDINGS + 1)
    for r in rare.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        seen[r.ending], distinct[r.ending] = r.n, r.words
    pairs = stage(bigrams(training, movers), "bigrams")
    kind, table = exchange(pairs, movers.size, classes, rounds)
    transition = np.log10((table + alpha) / (table.sum(axis=1, keepdims=True) + alpha * len(table)))
    number = np.concatenate((movers.counts, seen)).astype(float)
    members = np.bincount(kind, minlength=len(table))
    inside = np.bincount(kind, weights=number, minlength=len(table))
    emission = np.log10((number + beta) / (inside[kind] + beta * members[kind]))
    discount = sums.once / (sums.once + 2 * sums.twice) if sums.once else 0.5
    return Model(movers, kind, transition, emission, seen, distinct, discount, sums.total, sums.vocabulary)


def score(docs: DataFrame, training: DataFrame, **settings: float) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    A null text is empty: its only token is the end. Repeated rows are scored each, an
    empty table gives no rows, and without training documents every word is unseen.
    """
    counts = stage(word_counts(training), "word_counts")
    model = fit(training, counts, **settings)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    texts = id_and_text(docs)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    blocked = texts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(size // BLOCK_BYTES + 1)).cast("int"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        movers = shared.value.movers
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            found = _batch_tokens(batch)
            for block in np.unique(blocks):
                words, endings = (np.concatenate(c) for c in zip(*(found[k] for k in np.flatnonzero(blocks == block)), strict=True))
                mover = movers.of(words, endings)
                rare = np.unique(words[(mover >= len(movers.words)) & (mover < movers.size - 1)])
                yield pa.RecordBatch.from_arrays([pa.array(rare.view(np.int64)), pa.array(np.full(len(rare), block, dtype=np.int32))], ["word", "block"])

    answers = blocked.mapInArrow(asked, "word long, block int").join(counts.select("word", "n"), "word").select("block", "word", "n")

    def judge(rows: pa.Table, known: pa.Table) -> pa.Table:
        model = shared.value
        names, numbers = known.column("word").to_numpy().view(np.uint64), known.column("n").to_numpy()
        names, first = np.unique(names, return_index=True)
        numbers = numbers[first]
        movers = model.movers
        out = []
        for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").cast(pa.binary()), strict=True):
            words, endings = tokens(text.as_py() or b"")
            count = np.zeros(len(words), dtype=np.int64)
            if len(names):
                place = np.minimum(np.searchsorted(names, words), len(names) - 1)
                count = np.where(names[place] == words, numbers[place], 0)
            mover = movers.of(words, endings)
            often = mover < len(movers.words)
            count[often] = movers.counts[mover[often]]
            count[-1] = ends
            base, total = model.scores(words, endings, count)
            out.append((doc_id, len(words), int(np.count_nonzero(count)), model.total, base, total))
        kinds = [pa.int64()] * 4 + [pa.float64()] * 2
        columns = list(zip(*out, strict=True)) or [[]] * 6
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

    row = counts.filter(F.col("word") == int(_END.view(np.int64))).first()
    ends = row.n if row else 0
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, schema)
