"""Two tokenizers' tokens of the same bytes, aligned, with corpus-wide counts of linked pairs.

Byte offsets where tokens of both sides end cut a text into groups; two tokens are linked
where their bytes overlap. How often a pair of ids is linked in the whole corpus is counted
outside memory:

1. A task gathers records (pair, document, times) of whole documents up to a bound, and spills
   them as one run: the run's pairs in side-major order (second side, then first), cut by
   radix of the second id into zstd blocks with their counts, and the documents' records.
2. Per radix, runs are merged by a heap over their next second id, which adds up each pair
   and, as a second id comes to its end, yields its highest count. At most ``FAN_IN`` runs are merged by a
   task; of more, the merged blocks are merged again.
3. The totals are streamed back to the blocks of each run, and with them a run's documents
   get their sums.

A pair has one entry per run, however many documents hold it, so no id is a hot key; runs,
blocks and merges are bounded, and all that lies between the steps are tables in the shared folder.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrail.llm.packing import byte_level_encoder
from logtrail.llm.tables import id_and_text, stage

#: Records of a run, about; a document is never split.
RUN_RECORDS = 1 << 21
#: Ranges of second ids.
RADIXES = 64
#: Runs that one task merges.
FAN_IN = 64
_SHIFT = 17

_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


class Aligner:
    """Both tokenizers, and the groups and links of a text."""

    def __init__(self, first: str, second: str):
        import sentencepiece

        self.a = byte_level_encoder(first)
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        self.a_sizes = np.array([self._size(i) for i in range(self.a.n_vocab)])
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_sizes = np.array([len(p) for p in self.b_bytes])
        # the ids as texts with what goes before them: among the same side, first of its side
        self.written = [f"{mark}{i}" for mark, n in ((",", len(self.a_sizes)), (";", len(self.a_sizes)), (",", len(self.b_sizes)), ("|", len(self.b_sizes))) for i in range(n)]

    def _size(self, i: int) -> int:
        try:
            return len(self.a.decode_single_token_bytes(i))
        except KeyError:
            return 0

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or None where either's bytes are not those of a blank and the text."""
        whole = f" {text}".encode()
        b = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        a = self.a.encode_ordinary(f" {text}")
        if self.a.decode_bytes(a) != whole:
            return None
        return np.array(a), np.array(b)

    def align(self, text: str) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """Numbers of tokens, groups and links, the groups' print, and the linked pairs with their times."""
        found = self.tokens(text) if text else None
        if found is None:
            return 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = found
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        # every stretch between two ends lies in one token of each side, and no other stretch in the same two
        ends = np.union1d(a_ends, b_ends)
        linked = (b[np.searchsorted(b_ends, ends)] << _SHIFT) + a[np.searchsorted(a_ends, ends)]
        pairs, times = np.unique(linked, return_counts=True)
        return len(a), len(b), len(cuts), len(ends), self._print(a, b, a_ends, b_ends, cuts), pairs, times

    def _print(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, cuts: np.ndarray) -> str:
        """sha256 of ``a1,a2|b1;a3|b2,b3``: the tokens of a group, first side first."""
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        opens_a = np.diff(a_group, prepend=-1) > 0
        opens_b = np.diff(b_group, prepend=-1) > 0
        n = len(self.a_sizes)
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")] = a + n * opens_a
        order[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = b + 2 * n + len(self.b_sizes) * opens_b
        return hashlib.sha256("".join(map(self.written.__getitem__, order.tolist()))[1:].encode()).hexdigest()


@lru_cache(maxsize=1)
def _aligner(first: str, second: str) -> Aligner:
    return Aligner(first, second)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in one zstd frame; the first, which rises, as differences."""
    first = np.diff(arrays[0], prepend=0)
    body = b"".join(np.ascontiguousarray(x, dtype="<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in (first, *arrays[1:]))
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    """The ``n`` arrays of a frame."""
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    size = len(body) // (8 * n)
    parts = body.reshape(n, 8, size)
    out = [np.ascontiguousarray(p.T).view("<i8").ravel() for p in parts]
    return [np.cumsum(out[0]), *out[1:]]


def spill(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Runs: a row with the documents' columns and records (``radix`` null), and a row per radix with pairs and counts."""
    per_radix = -(-_sizes(first, second) // RADIXES)

    def flush(kept: list) -> pa.RecordBatch:
        run = uuid.uuid4().hex
        sizes = [len(d[6]) for d in kept]
        pairs, place = np.unique(np.concatenate([d[6] for d in kept]), return_inverse=True)
        times = np.concatenate([d[7] for d in kept])
        counts = np.bincount(place, weights=times, minlength=len(pairs)).astype(np.int64)
        bounds = np.searchsorted(pairs, np.arange(RADIXES + 1) * per_radix << _SHIFT)
        # a document's places rise, so their differences are small; a negative one opens the next
        rows = [(run, None, 0, _pack(place, times), [dict(zip(_COLUMNS, d[:6], strict=True)) | {"n": n} for d, n in zip(kept, sizes, strict=True)])]
        for radix, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if low < high:
                rows.append((run, radix, int(high - low), _pack(pairs[low:high], counts[low:high]), None))
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["run", "radix", "pairs", "block", "documents"]
    document = pa.struct([("doc_id", pa.int64()), *((c, pa.int64()) for c in _COLUMNS[1:5]), ("groups_sha256", pa.string()), ("n", pa.int64())])
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.list_(document)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, kept, held = _aligner(first, second), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                *counts, pairs, times = aligner.align(text.as_py() or "")
                kept.append((doc_id, *counts, pairs, times))
                held += len(pairs) + 8
                if held > RUN_RECORDS:
                    yield flush(kept)
                    kept, held = [], 0
        if kept:
            yield flush(kept)

    schema = f"run string, radix int, pairs long, block binary, documents array<struct<{_DOC.replace(' ', ':').replace(',:', ',')},n:long>>"
    return id_and_text(docs).mapInArrow(run, schema)


def _sizes(first: str, second: str) -> int:
    return len(_aligner(first, second).b_sizes)


def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and added counts of each second id in turn, from runs of rising pairs.

    The heap holds every run by the second id it has next; all runs at the lowest one are
    taken together, so a second id is whole when it is yielded.
    """
    heap = []
    for k, (pairs, _) in enumerate(runs):
        starts = np.flatnonzero(np.diff(pairs >> _SHIFT, prepend=-1))
        if len(starts):
            bounds = [*starts.tolist(), len(pairs)]
            heap.append((int(pairs[0]) >> _SHIFT, k, 0, bounds))
    heapq.heapify(heap)
    while heap:
        side, parts = heap[0][0], []
        while heap and heap[0][0] == side:
            _, k, at, bounds = heap[0]
            pairs, counts = runs[k]
            parts.append((pairs[bounds[at] : bounds[at + 1]], counts[bounds[at] : bounds[at + 1]]))
            if at + 2 < len(bounds):
                heapq.heapreplace(heap, (int(pairs[bounds[at + 1]]) >> _SHIFT, k, at + 1, bounds))
            else:
                heapq.heappop(heap)
        if len(parts) == 1:
            yield parts[0]
            continue
        pairs, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        yield pairs, np.bincount(place, weights=np.concatenate([c for _, c in parts])).astype(np.int64)


def _merged(blocks: DataFrame) -> DataFrame:
    """One block per radix and group of runs: ``radix, grp, block`` from the same columns."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        got = list(merge([tuple(_unpack(b.as_py(), 2)) for b in table.column("block")]))
        block = _pack(*(np.concatenate([g[k] for g in got]) for k in (0, 1)))
        return pa.table({"radix": pa.array([key[0].as_py()], pa.int32()), "grp": pa.array([key[1].as_py()], pa.int64()), "block": pa.array([block], pa.binary())})

    return blocks.select("radix", "grp", "block").groupBy("radix", "grp").applyInArrow(run, "radix int, grp long, block binary")


def totals(blocks: DataFrame, runs: int) -> DataFrame:
    """``radix, block``: every pair of a radix with its corpus-wide count, merged in as many rounds as ``runs`` needs."""
    groups = max(1, -(-runs // FAN_IN))
    left = blocks.withColumn("grp", F.pmod(F.xxhash64("run"), F.lit(groups)))
    while True:
        left = stage(_merged(left), "pair-totals")
        if groups == 1:
            return left.select("radix", "block")
        groups = -(-groups // FAN_IN)
        left = left.withColumn("grp", F.pmod(F.col("grp"), F.lit(groups)))


def _answers(blocks: DataFrame, whole: DataFrame, runs: int) -> DataFrame:
    """``run, radix, answer``: for each pair of a run's block its corpus-wide count, negative unless its second id has no higher one."""
    groups = max(1, -(-runs // FAN_IN))
    mine = blocks.select("radix", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("grp"), "run", "block")
    every = whole.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"), F.lit(None).cast("string").alias("run"), "block")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        names, found = table.column("run").to_pylist(), table.column("block")
        at = names.index(None)
        pairs, counts = _unpack(found[at].as_py(), 2)
        starts = np.flatnonzero(np.diff(pairs >> _SHIFT, prepend=-1))
        highest = np.repeat(np.maximum.reduceat(counts, starts), np.diff(starts, append=len(pairs)))
        signed = np.where(counts == highest, counts, -counts)
        out = {"run": [], "radix": [], "answer": []}
        for k, name in enumerate(names):
            if k != at:
                asked = _unpack(found[k].as_py(), 2)[0]
                answer = signed[np.searchsorted(pairs, asked)]
                out["run"].append(name)
                out["radix"].append(key[0].as_py())
                out["answer"].append(_pack(answer))
        return pa.table([pa.array(out["run"], pa.string()), pa.array(out["radix"], pa.int32()), pa.array(out["answer"], pa.binary())], names=list(out))

    return mine.unionByName(every).groupBy("radix", "grp").applyInArrow(run, "run string, radix int, answer binary")


def align(docs: DataFrame, first: str, second: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of ``docs``.

    ``first`` is a byte-level BPE file of the tokenizers library, read with a blank before the
    text, ``second`` a sentencepiece model, which adds that blank; both are paths on every machine. ``n_best`` counts links
    whose pair is linked as often as any of its second id, ``count_sum`` adds the pairs' counts over the links. Null and empty
    texts, and those that either side does not give back byte for byte, have zeros and an empty print. Repeated
    rows count each time, rows without a number as any others; other columns are not read; an empty table gives no rows.
    """
    spilled = stage(spill(docs, first, second), "pair-runs")
    blocks, bodies = spilled.filter("radix IS NOT NULL").select("run", "radix", "block"), spilled.filter("radix IS NULL").select("run", "block", "documents")
    runs = bodies.count()
    answers = _answers(blocks, totals(blocks, runs), runs)

    def run(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        documents = pa.concat_arrays(left.column("documents").chunks).flatten()
        place, times = _unpack(left.column("block")[0].as_py(), 2)
        parts = sorted(zip(right.column("radix").to_pylist(), right.column("answer").to_pylist(), strict=True))
        signed = np.concatenate([np.empty(0, np.int64), *(_unpack(blob, 1)[0] for _, blob in parts)])
        value = signed[place]
        sizes = documents.field("n").to_numpy()
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        sums = [np.concatenate(([0], np.cumsum(v))) for v in (times * (value > 0), times * np.abs(value))]
        best, total = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
        return pa.table([*(documents.field(c) for c in _COLUMNS[:5]), pa.array(best), pa.array(total), documents.field("groups_sha256")], names=names)

    names = [*_COLUMNS[:5], "n_best", "count_sum", "groups_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()]
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return bodies.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(run, schema)
