"""Removal of repeated byte strings by a distributed suffix order over a difference cover.

A difference cover is a sample of the suffixes such that any two equal strings of the
wanted length contain a sampled suffix at the same place. Offsets 1 and 2 modulo 3 have
that property, but two thirds of all bytes would be sorted as rows. The sample here is
taken by content: in every window of ``length`` bytes the place of the 64-byte string
with the smallest hash, one byte in about 170. Equal windows choose equal places.

1. Sampled suffixes are named by their first 64 bytes and by the whole context
   that their windows span. Names are fingerprints, so naming needs no ranks.
   Those of one text with equal names are one row.
2. Names that occur once are settled: nothing there repeats. Contexts that occur
   again are settled too: all their windows repeat.
3. What still ties, suffixes with one name and different contexts, is recursed on:
   sorted by the bytes to the right, and by the bytes to the left.
4. The other suffixes, a window's start to the left of its sampled suffix, are merged in
   through the bytes between. Adjacent prefixes in the two orders give the
   longest common stretch on each side, and so which windows repeat. Windows that
   neighbours leave open, as they match different suffixes left and right, are
   named by a fingerprint of all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtrail.llm import hashing
from logtrail.llm.tables import id_and_text, stage

LENGTH = 400
GRAM = 64
_CHUNK = 1 << 23
_PLACE = np.uint64((1 << 24) - 1)


def _print(text: str) -> Column:
    """A 64-bit name of a whole text, so that rows of one document number, or of none, stay apart."""
    return F.xxhash64(F.col(text).cast("string"))


def _same_row(doc_id: str, text: str) -> Column:
    """The condition of a join on a row's number, which may be null, and the print of its text."""
    return F.col(doc_id).cast("long").eqNullSafe(F.col("_doc_id")) & (_print(text) == F.col("_print"))


def sample(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Sampled places with the first and last window that chose each, their gram's and context's fingerprints."""
    gram = min(GRAM, length)
    width = length - gram + 1
    if len(text) < length:
        return (np.empty(0, dtype=np.int64),) * 3 + (np.empty(0, dtype=np.uint64),) * 2
    sums = hashing.prefix_sums(np.frombuffer(text, dtype=np.uint8))
    places = np.arange(len(text) - gram + 1)
    grams = hashing.spans(sums, places, places + gram)
    chosen = []
    for begin in range(0, len(text) - length + 1, _CHUNK):
        n = min(_CHUNK, len(text) - length + 1 - begin)
        order = (grams[begin : begin + n + width - 1] & ~_PLACE) | np.arange(n + width - 1, dtype=np.uint64)
        blocks = np.full(-(-len(order) // width) * width, ~np.uint64(0))
        blocks[: len(order)] = order
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(blocks, axis=1).ravel()
        least = np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])
        chosen.append((least & _PLACE).astype(np.int64) + begin)
    anchor = np.concatenate(chosen)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.concatenate((first[1:], [len(anchor)])) - 1
    anchor = anchor[first]
    context = hashing.spans(sums, first, last + length)
    context = hashing.mix(context ^ ((anchor - first).astype(np.uint64) << np.uint64(32)) ^ (last - first).astype(np.uint64))
    return anchor, first, last, grams[anchor], context


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    for text in batch.column(name).cast(pa.binary()):
        yield text.as_py() or b""


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Small parts of the batches, so that few rows are Python objects at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _alike(first: np.ndarray, last: np.ndarray, gram: np.ndarray, context: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Of a row's places with one gram and context the first, how many there are, and, if several, the stretches that their windows cover.

    A context that a text holds again repeats whatever the others hold, so a text that goes
    on with one line has a row for the line's places, not one per place.
    """
    order = np.lexsort((context, gram))
    begin, end = first[order], last[order] + length
    fresh = np.concatenate(([True], (gram[order][1:] != gram[order][:-1]) | (context[order][1:] != context[order][:-1])))
    begins = np.flatnonzero(fresh)
    times = np.diff(np.append(begins, len(order)))
    # places are in order, so are the ends of their windows
    apart = np.flatnonzero(fresh | np.concatenate(([True], begin[1:] > end[:-1])))
    until = end[np.append(apart[1:], len(order)) - 1]
    of = np.cumsum(fresh)[apart] - 1
    several = times[of] > 1
    sizes = np.bincount(of[several], minlength=len(times))
    values = pa.StructArray.from_arrays([pa.array(begin[apart][several]), pa.array(until[several])], ["start", "end"])
    return order[begins], times, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), type=pa.int32()), values)


def _sampled(docs: DataFrame, length: int) -> DataFrame:
    names = ["doc_id", "print", "anchor", "first", "last", "gram", "context", "times", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, name, text in zip(batch.column(0), batch.column("print"), _texts(batch), strict=True):
                anchor, first, last, gram, context = sample(text, length)
                if len(anchor):
                    one, times, spans = _alike(first, last, gram, context, length)
                    same = [pa.array([v] * len(one), type=pa.int64()) for v in (doc_id.as_py(), name.as_py())]
                    rest = [pa.array(v[one]) for v in (anchor, first, last, gram.view(np.int64), context.view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*same, *rest, pa.array(times), spans.cast(_SPANS)], names)

    schema = "doc_id long, print long, anchor long, first long, last long, gram long, context long, times long, spans array<struct<start: long, end: long>>"
    return id_and_text(docs).withColumn("print", _print("text")).mapInArrow(run, schema)


def _with_bytes(ties: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Contexts with the bytes right of the gram and, reversed, left of it."""
    per_row = ties.groupBy(F.col("doc_id").alias("_doc_id"), F.col("print").alias("_print")).agg(F.collect_list(F.struct("gram", "context", "n", "anchor", "first", "last")).alias("places"))
    gram = min(GRAM, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = []
            for places, text in zip(batch.column("places").to_pylist(), _texts(batch), strict=True):
                for p in places:
                    a, first, last = p["anchor"], p["first"], p["last"]
                    out.append((p["gram"], p["context"], p["n"], a - last, a - first, text[a + gram : last + length], text[first:a][::-1]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            names = ["gram", "context", "n", "least", "most", "right", "left"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names)

    joined = id_and_text(docs).join(per_row, _same_row("doc_id", "text")).select("places", "text")
    schema = "gram long, context long, n long, least int, most int, right binary, left binary"
    return joined.mapInArrow(run, schema).dropDuplicates(["gram", "context"])


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = np.frombuffer(a, dtype=np.uint8, count=n) != np.frombuffer(b, dtype=np.uint8, count=n)
    return int(x.argmax())


def _neighbours(ties: DataFrame, by: tuple[str, str], length: int) -> DataFrame:
    """Common stretches of each context with its neighbours in the order of ``gram`` and the columns ``by``.

    A row per neighbour: ``gram, context, right, left`` (lengths, the gram included on
    the right). Rows at the edges of sorted partitions meet in a second, small step.
    """
    gram = min(GRAM, length)
    columns = ["gram", "context", "right", "left"]
    ordered = ties.select(columns).repartitionByRange("gram", *by).sortWithinPartitions("gram", *by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, previous, opening = TaskContext.get().partitionId(), None, None
        for batch in _slices(batches, 1024):
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if opening is None:
                    opening = row
                if previous is not None and previous[0] == row[0]:
                    r, le = gram + common(row[2], previous[2]), common(row[3], previous[3])
                    out += [(row[0], row[1], r, le), (row[0], previous[1], r, le)]
                previous = row
            yield _stretches([(*o, None, None, None, None) for o in out])
        if opening is not None:
            yield _stretches([(row[0], row[1], None, None, row[2], row[3], task, end) for row, end in ((opening, 0), (previous, 1))])

    schema = "gram long, context long, r int, l int, right binary, left binary, task int, end int"
    found = stage(ordered.mapInArrow(run, schema), "neighbours")
    # two rows per partition: their number depends on the cluster, not on the rows
    edges = found.filter("task is not null").orderBy("task", "end").collect()
    meeting = []
    for a, b in zip(edges[1::2], edges[2::2], strict=False):
        if a.gram == b.gram:
            r, le = gram + common(bytes(a.right), bytes(b.right)), common(bytes(a.left), bytes(b.left))
            meeting += [(a.gram, a.context, r, le), (b.gram, b.context, r, le)]
    inner = found.filter("task is null").select("gram", "context", "r", "l")
    return inner.union(ties.sparkSession.createDataFrame(meeting, inner.schema))


def _stretches(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    names = ["gram", "context", "r", "l", "right", "left", "task", "end"]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names)


def _repeating(ties: DataFrame, length: int) -> DataFrame:
    """``gram, context, low, high``: windows that start low..high bytes left of the sampled suffix repeat."""
    pairs = _neighbours(ties, ("right", "left"), length).union(_neighbours(ties, ("left", "right"), length))
    # what the pairs show, and the most that the longest stretches on each side could allow
    seen = pairs.groupBy("gram", "context").agg(F.max("r").alias("r"), F.max("l").alias("l"), F.collect_set(F.struct((F.lit(length) - F.col("r")).alias("low"), F.col("l").alias("high"))).alias("shown"))
    bounds = ties.select("gram", "context", "n", "least", "most").join(seen, ["gram", "context"])
    bounds = bounds.withColumn("low", F.greatest(F.lit(length) - F.col("r"), "least")).withColumn("high", F.least("l", "most"))
    inside = F.transform("shown", lambda s: F.struct(F.greatest(s["low"], F.col("low")).alias("low"), F.least(s["high"], F.col("high")).alias("high")))
    bounds = bounds.filter("low <= high").withColumn("shown", F.array_sort(F.filter(inside, lambda s: s["low"] <= s["high"])))
    reached = F.aggregate("shown", F.col("low") - 1, lambda end, s: F.when(s["low"] <= end + 1, F.greatest(end, s["high"])).otherwise(end))
    bounds = stage(bounds.withColumn("decided", reached >= F.col("high")), "bounds")
    shown = bounds.filter("n = 1").select("gram", "context", F.explode("shown").alias("s")).select("gram", "context", "s.low", "s.high")
    # windows that neighbours leave open are compared with all of their name by a fingerprint
    unsure = bounds.filter("n = 1 and not decided").groupBy("gram").agg(F.min("low").alias("from"), F.max("high").alias("to"))
    again = bounds.select("gram", "context", "low", "high").join(unsure, "gram")
    again = again.select("gram", "context", F.greatest("low", "from").alias("low"), F.least("high", "to").alias("high")).filter("low <= high")
    wide = ties.select("gram", "context", "n", "right", "left").join(again, ["gram", "context"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for g, c, n, right, left, low, high in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                data = np.frombuffer(left[::-1] + right, dtype=np.uint8)
                d = np.arange(low, high + 1)
                at = len(left) - d
                # the gram, equal in all, is not among the bytes
                named = hashing.spans(hashing.prefix_sums(data), at, at + length - min(GRAM, length))
                same = [pa.array([v] * len(d), type=pa.int64()) for v in (g, c, n)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(d.astype(np.int32)), pa.array(named.view(np.int64))], ["gram", "context", "n", "d", "name"])

    named = stage(wide.mapInArrow(name, "gram long, context long, n long, d int, name long"), "named")
    repeated = named.groupBy("gram", "d", "name").agg(F.sum("n").alias("times")).filter("times > 1").drop("times")
    more = named.filter("n = 1").join(repeated, ["gram", "d", "name"]).select("gram", "context", F.col("d").alias("low"), F.col("d").alias("high"))
    return shown.union(more)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, print, start, end`` of byte ranges covered by windows that occur again; they may overlap."""
    rows = stage(_sampled(docs, length), "sampled")
    grams = rows.groupBy("gram").agg(F.sum("times").alias("members"), (F.min("context") != F.max("context")).alias("several")).filter("members > 1")
    shared = stage(rows.join(grams.drop("members"), "gram"), "shared")
    place = F.struct("doc_id", "print", "anchor", "first", "last")
    classes = stage(shared.groupBy("gram", "context").agg(F.sum("times").alias("n"), F.first("several").alias("several"), F.min(place).alias("p")), "classes")
    copies = shared.join(classes.filter("n > 1").select("gram", "context"), ["gram", "context"])
    once = F.array(F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("end")))
    covered = F.when(F.col("times") > 1, F.col("spans")).otherwise(once)
    whole = copies.select("doc_id", "print", F.explode(covered).alias("s")).select("doc_id", "print", "s.start", "s.end")
    open_ = classes.filter("several").select("gram", "context", "n", "p.*")
    ties = stage(_with_bytes(open_, docs, length), "ties")
    single = open_.filter("n = 1").join(_repeating(ties, length), ["gram", "context"])
    return whole.union(single.select("doc_id", "print", (F.col("anchor") - F.col("high")).alias("start"), (F.col("anchor") - F.col("low") + length).alias("end")))


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` with the column ``_spans`` of each row's spans, null if there are none."""
    spans = repeated_spans(docs, length).groupBy(F.col("doc_id").alias("_doc_id"), F.col("print").alias("_print")).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    return docs.join(spans, _same_row("doc_id", "text"), "left").drop("_doc_id", "_print")


def _gone(text: bytes, spans: list[dict] | None) -> np.ndarray:
    """Which bytes of a text its spans cover."""
    depth = np.zeros(len(text) + 1, dtype=np.int64)
    if spans:
        np.add.at(depth, [s["start"] for s in spans], 1)
        np.add.at(depth, [s["end"] for s in spans], -1)
    return np.cumsum(depth)[:-1] > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row, without each byte in a string of ``length`` bytes that also starts elsewhere.

    Texts are UTF-8 bytes, a null text is empty, and matches stay within a row; rows
    with equal number and text are two documents, so all their long strings repeat.
    Rows without a number are documents as any other.
    An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = []
            for doc_id, spans, text in zip(batch.column("doc_id").to_pylist(), batch.column("_spans").to_pylist(), _texts(batch), strict=True):
                gone = _gone(text, spans)
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                runs = np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1])))
                out.append((doc_id, len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * len(_CUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _CUT, strict=True)], schema=_CUT)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_spans(id_and_text(docs), length).mapInArrow(run, schema)


def _long_enough(gone: np.ndarray, text: bytes, least_words: int) -> np.ndarray:
    """Of the bytes that are ``gone`` those in runs of ``LENGTH`` bytes or of ``least_words`` whole words."""
    edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first, last = hashing.word_bounds(np.frombuffer(text, dtype=np.uint8))
    words = np.searchsorted(last, ends, side="right") - np.searchsorted(first, begins)
    out = gone.copy()
    for k in np.flatnonzero((ends - begins < LENGTH) & (words < least_words)):
        out[begins[k] : ends[k]] = False
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """``docs`` with all its columns and the texts that ``remove_repeats`` leaves.

    With ``least_words`` a run of repeated bytes that is shorter than ``LENGTH`` goes only if it holds
    so many whole words. A character of which a byte went goes whole. Untouched texts stay as they are, nulls too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            place = batch.schema.get_field_index("text")
            new = []
            for spans, old, text in zip(batch.column("_spans").to_pylist(), batch.column("text"), _texts(batch), strict=True):
                gone = _gone(text, spans) if spans else None
                if spans and least_words:
                    gone = _long_enough(gone, text, least_words)
                cut = gone is not None and gone.any()
                new.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes().decode(errors="ignore") if cut else old.as_py())
            columns = [pa.array(new, type=pa.string()) if k == place else c for k, c in enumerate(batch.columns)]
            keep = [k for k, name in enumerate(batch.schema.names) if name != "_spans"]
            yield pa.RecordBatch.from_arrays([columns[k] for k in keep], [batch.schema.names[k] for k in keep])

    return _with_spans(docs, length).mapInArrow(run, docs.schema)
