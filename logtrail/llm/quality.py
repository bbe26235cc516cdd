"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class is one Gaussian over transformed statistics of a text. Its covariance is
shrunk twice, towards the covariance of all classes and towards a multiple of the
identity, so it can be factored even where a statistic never varies. A document's
score is the difference of the two log densities, read off triangular solves with the
Cholesky factors, plus the log of the class shares; squashed to 0..1 without
saturating, so that far documents still differ.
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

FEATURES = (
    "words", "word_length", "symbols", "bars", "exclamations", "capitals", "digits", "stops",
    "repeats", "distinct", "top_word", "repeated_lines", "line_words", "repeated_windows",
)
FEATURE_SCHEMA = "doc_id long, features array<double>"

_KIND = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate((b"#*$%&<>^~=_@\\{}[]", b"|", b"!", bytes(range(65, 91)), b"0123456789", b".,;:?"), start=1):
    _KIND[list(_chars)] = _k
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of a text; an empty one has those of no words."""
    data = np.frombuffer(text, dtype=np.uint8)
    size = max(1, len(data))
    kinds = np.bincount(_KIND[data], minlength=7)
    words = hashing.words(text)
    n = max(1, len(words))
    values, counts = np.unique(words, return_counts=True)
    lines = [line for line in text.split(b"\n") if line.strip()]
    eights = hashing.windows(words, 4)
    letters = max(1, int(_LETTER[data].sum()))
    share = np.array(
        [
            kinds[1] / size,
            kinds[2] / size,
            kinds[3] / size,
            kinds[4] / letters,
            kinds[5] / size,
            kinds[6] / size,
            np.count_nonzero(words[1:] == words[:-1]) / n,
            1 - len(values) / n,
            (counts.max() if len(counts) else 0) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            len(lines) / n,
            1 - len(np.unique(eights)) / max(1, len(eights)),
        ]
    )
    return np.concatenate(([np.log1p(len(words)), np.log1p(len(data) / n)], np.log(share + 0.01)))


def features(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``features``. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            rows = [statistics(t.as_py() or b"") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tolist() for r in rows], type=pa.list_(pa.float64()))], ["doc_id", "features"]
            )

    return id_and_text(docs).mapInArrow(run, FEATURE_SCHEMA)


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians by their means and Cholesky factors, and the log of the class shares' ratio."""

    means: np.ndarray
    factors: np.ndarray
    log_ratio: float
    fallback: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.fallback is not None:
            return np.full(len(x), self.fallback)
        logs = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            solved = np.linalg.solve(factor, (x - mean).T)
            logs.append(-0.5 * (solved**2).sum(axis=0) - np.log(np.diag(factor)).sum())
        z = logs[1] - logs[0] + self.log_ratio
        return 0.5 + 0.5 * z / (1 + np.abs(z))


def fit(labelled: DataFrame, shrink_pooled: float = 0.1, shrink_identity: float = 0.01) -> Discriminant:
    """Fit on rows (``features``, ``quality`` 0/1); other labels and nulls are left out.

    Spark sums counts, vectors and products per class; only those sums, whose number
    depends on the number of statistics, come to the driver. Without rows of both
    classes every score is the class there is, or 0.5.
    """
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([np.ones(batch.num_rows), np.array(batch.column(0).to_pylist())])
                y = np.array(batch.column(1).to_pylist())
                for c in (0, 1):
                    total[c] += x[y == c].T @ x[y == c]
        c, i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v.ravel()) for v in (c.astype(np.int32), i.astype(np.int32), j.astype(np.int32), total)], ["c", "i", "j", "value"]
        )

    rows = labelled.filter(F.col("quality").isin(0, 1)).select("features", F.col("quality").cast("int").alias("quality"))
    total = np.zeros((2, d + 1, d + 1))
    for r in rows.mapInArrow(sums, "c int, i int, j int, value double").groupBy("c", "i", "j").agg(F.sum("value").alias("v")).collect():
        total[r.c, r.i, r.j] = r.v
    n = total[:, 0, 0]
    if min(n) == 0:
        return Discriminant(np.zeros(0), np.zeros(0), 0.0, 0.5 if max(n) == 0 else float(n[1] > 0))
    means = total[:, 0, 1:] / n[:, None]
    scatter = total[:, 1:, 1:] - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    factors = []
    for c in (0, 1):
        cov = (1 - shrink_pooled) * scatter[c] / n[c] + shrink_pooled * pooled
        level = max(np.trace(pooled) / d, 1e-6)
        factors.append(np.linalg.cholesky((1 - shrink_identity) * cov + shrink_identity * level * np.eye(d)))
    return Discriminant(means, np.array(factors), float(np.log(n[1] / n[0])))


def score(rows: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id`` and ``score`` in 0..1, higher for likelier label 1, of rows from ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **shrinkage: float) -> DataFrame:
    """Scores of all documents by a model of the labelled ones: ``doc_id, score, predicted``.

    ``labels`` has ``doc_id, quality``; rows to hold out are left out by the caller.
    Repeated documents or labels count each time. ``docs`` may have any other columns.
    Empty tables give no rows or the score 0.5; null and empty texts are scored as texts
    without words.
    """
    seen = stage(features(docs), "features")
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality"))
    model = fit(seen.join(given, "doc_id"), **shrinkage)
    return score(seen, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
