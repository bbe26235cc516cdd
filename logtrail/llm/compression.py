"""Quality rules by compression bands.

A text that repeats itself compresses too well, and random or encoded text hardly at
all. The zstandard ratio (bytes over compressed bytes) is taken of the whole text and of
chunks of fixed size; both must lie in a band that depends on the length, as short
inputs leave the compressor less to find. The chunks see a bad stretch in a long text
whose whole ratio is ordinary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from logtrail.llm import hashing
from logtrail.llm.tables import id_and_text

#: From this many bytes on, the lowest and the highest ratio of ordinary text.
BANDS = ((0, 0.0, 4.0), (200, 1.05, 3.0), (500, 1.15, 3.2), (1000, 1.25, 3.6), (4000, 1.35, 4.5), (16000, 1.4, 6.0), (64000, 1.4, 8.0))
CHUNK = 4096
#: A text may have this share of chunks outside their band.
BAD_CHUNKS = 0.25
SYMBOLS = b"#*$%&|<>"


def band(size: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(BANDS) if size >= least)


def ratio(text: bytes, compressor: zstandard.ZstdCompressor) -> float:
    return len(text) / max(1, len(compressor.compress(text)))


def verdict(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float, float, bool]:
    """Ratio of the whole, lowest and highest of the chunks, and whether all is within bounds."""
    whole = ratio(text, compressor)
    # a short rest is left out, as its ratio says little; the whole ratio covers it
    parts = [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)]
    ratios = [(ratio(p, compressor), *band(len(p))) for p in parts if len(p) >= CHUNK // 2 or len(parts) == 1]
    low, high = band(len(text))
    bad = sum(not least <= r <= most for r, least, most in ratios)
    whole_fine = low <= whole <= high and bad <= BAD_CHUNKS * len(ratios)
    values = [r for r, _, _ in ratios]
    return whole, min(values, default=0.0), max(values, default=0.0), whole_fine


def surface(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in them, symbols, repeated lines, and words in repeated windows of eight words."""
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends = hashing.word_bounds(data)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = int((heads[ends] - heads[starts]).sum())
    symbols = int(_SYMBOL[data].sum())
    seen, lines = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            lines += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    n = len(starts)
    repeated = 0
    if n >= 9:
        # 64-bit names; equal windows of one text are what counts
        names = hashing.windows(hashing.spans(hashing.prefix_sums(data), starts, ends), 8)
        _, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
        again = np.flatnonzero(counts[inverse] > 1)
        depth = np.zeros(n + 1, dtype=np.int64)
        np.add.at(depth, again, 1)
        np.add.at(depth, again + 8, -1)
        repeated = int(np.count_nonzero(np.cumsum(depth)[:-1]))
    return n, chars, symbols, lines, repeated


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True

_RULED = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("chunk_low", pa.float64()), ("chunk_high", pa.float64()),
    ]
)


def rules(docs: DataFrame, least_words: int = 20, most_repeated: int = 30, level: int = 3) -> DataFrame:
    """Counts, ratios and verdict of every row of ``docs``.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeated`` per
    cent of them in repeated windows. ``kept``: not failed and within the bands. Null,
    empty and blank texts have no words and fail; repeated rows are judged each; an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            out = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text = value.as_py() or b""
                n, chars, symbols, lines, repeated = surface(text)
                failed = n < least_words or 100 * repeated > most_repeated * n
                whole, low, high, fine = verdict(text, compressor)
                out.append((doc_id, n, chars, symbols, lines, repeated, failed, fine and not failed, whole, low, high))
            columns = list(zip(*out, strict=True)) or [[]] * len(_RULED)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _RULED, strict=True)], schema=_RULED)

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, ratio double, chunk_low double, chunk_high double"
    )
    return id_and_text(docs).mapInArrow(run, schema)
