"""Best-fit packing by bin completion.

Documents become token pieces; only the number of pieces of each length decides how
they are packed, and there are at most as many lengths as a sequence has places. Spark
counts the lengths; the search runs over those counts on the driver: it takes the
largest length left, enumerates fillings of the rest of its sequence that no other
filling dominates, and repeats the filling as often as the counts allow. Waste beyond
what a better solution could afford is pruned; best-fit-decreasing over the same
counts is the first incumbent. The plan is a short list of fillings with their numbers;
every piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtrail.llm.tables import id_and_text, stage

Plan = list[tuple[tuple[int, ...], int]]


@lru_cache(maxsize=2)
def byte_level_encoder(path: str):
    """An encoder with the ids of a byte-level BPE vocabulary file of the tokenizers library.

    The merges of such a vocabulary are in the order of their ids, which is how tiktoken
    keeps ranks; it gives the same ids several times as fast.
    """
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, vocabulary: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and the piece's number among those of its length and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = byte_level_encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encoder.encode(text.as_py() or "", allowed_special="all"), end_id], dtype="<u4")
                first = len(ids) % limit or limit
                for number, start in enumerate([0, *range(first, len(ids), limit)]):
                    part = ids[start : start + (limit if number else first)]
                    out.append((doc_id, number, start, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
                    seen[len(part)] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"
    return id_and_text(docs).mapInArrow(run, schema)


def lower_bound(counts: dict[int, int], limit: int) -> int:
    """Sequences that any packing needs: pieces too large to share, and what the small ones need beyond the room left."""
    number = np.zeros(limit + 1, dtype=np.int64)
    number[list(counts)] = list(counts.values())
    volume = number * np.arange(limit + 1)
    upto, volume_upto = np.cumsum(number), np.cumsum(volume)
    middle = limit // 2
    small = np.arange(1, middle + 1)
    alone = upto[limit] - upto[limit - small]
    half = upto[limit - small] - upto[middle]
    room = half * limit - (volume_upto[limit - small] - volume_upto[middle])
    rest = volume_upto[middle] - volume_upto[small - 1]
    shared = alone + half + np.maximum(0, -(-(rest - room) // limit))
    return int(max(-(-volume_upto[limit] // limit), shared.max(initial=0)))


def best_fit(counts: dict[int, int], limit: int) -> Plan:
    """Best fit with decreasing lengths, over counts: equal sequences are filled together."""
    open_: Counter[tuple[int, tuple[int, ...]]] = Counter()
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room, filling in sorted(k for k in open_ if k[0] >= length):
            if not left:
                break
            have, each = open_[room, filling], room // length
            full = min(have, left // each)
            rest = left - full * each if full < have else 0
            some = min(rest, each - 1)
            for number, times in ((each, full), (some, 1 if some else 0)):
                if times:
                    open_[room, filling] -= times
                    open_[room - number * length, filling + (length,) * number] += times
                    left -= number * times
            open_ += Counter()
        each = limit // length
        if left // each:
            open_[limit - each * length, (length,) * each] += left // each
        if left % each:
            open_[limit - left % each * length, (length,) * (left % each)] += 1
    return [(filling, times) for (_, filling), times in open_.items() if times]


def _fillings(counts: dict[int, int], lengths: list[int], room: int, waste: int, most: int) -> list[tuple[int, ...]]:
    """Up to ``most`` fillings of ``room`` that waste at most ``waste``, fullest first, none dominated by another.

    A bit set of all sums that the lengths can make tells which branches still reach the
    wanted fill.
    """
    sums = 1
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for length in reversed(lengths):
        for _ in range(min(counts[length], room // length)):
            grown = (sums | sums << length) & mask
            if grown == sums:
                break
            sums = grown
        reach.append(sums)
    reach.reverse()  # reach[i]: sums of lengths[i:]
    found: list[tuple[int, ...]] = []
    negative = [-k for k in lengths]
    steps = 0

    def search(i: int, left: int, chosen: tuple[int, ...], allowed: int) -> None:
        nonlocal steps
        steps += 1
        if len(found) >= most or steps > 300:
            return
        i = max(i, bisect_left(negative, -left))
        if left <= allowed and not any(length <= left for length in lengths[i:] if counts[length] > chosen.count(length)):
            found.append(chosen)
            return
        while i < len(lengths):
            window = (reach[i] >> max(0, left - allowed)) & ((1 << (min(left, allowed) + 1)) - 1)
            if not window:
                return
            length = lengths[i]
            if counts[length] > chosen.count(length):
                search(i, left - length, (*chosen, length), allowed)
                if len(found) >= most or steps > 300:
                    return
            i += 1
        if left <= allowed:
            found.append(chosen)

    fullest = sums.bit_length() - 1
    for allowed in (room - fullest, min(waste, room - fullest + 16)):
        if room - fullest <= waste and len(found) < most:
            steps = 0
            found_before = len(found)
            search(0, room, (), allowed)
            if allowed == waste and len(found) == found_before:
                break
    unique = sorted(set(found), key=lambda f: (-sum(f), len(f), tuple(-k for k in f)))
    return [f for k, f in enumerate(unique) if not any(_dominates(g, f) for g in unique[:k])]


def _dominates(big: tuple[int, ...], small: tuple[int, ...]) -> bool:
    """Whether each part of ``small`` fits in a part of ``big`` of its own, so ``big`` is at least as good."""
    return len(small) == len(big) and all(b >= s for b, s in zip(sorted(big), sorted(small), strict=True))


def plan(counts: dict[int, int], limit: int = 2048, nodes: int = 5000, width: int = 4) -> Plan:
    """Fillings and how often each is used, for pieces given by the number of each length.

    Depth-first over runs of equal fillings around the largest length left. A branch ends
    when its waste leaves no way to beat the incumbent; the search ends at the lower bound
    or after ``nodes`` fillings, a bound of the work and not of the pieces.
    """
    total = sum(k * c for k, c in counts.items())
    incumbent = best_fit(counts, limit)
    used, bound = sum(t for _, t in incumbent), lower_bound(counts, limit)
    # one table of the pieces left and one path; going back puts a filling's pieces back
    left = {k: c for k, c in counts.items() if c}
    path: Plan = []
    bins = wasted = 0

    def take(filling: tuple[int, ...], times: int) -> None:
        for length, many in Counter(filling).items():
            now = left.get(length, 0) - many * times
            if now:
                left[length] = now
            else:
                left.pop(length, None)

    def choices() -> list[tuple[tuple[int, ...], int]]:
        slack = (used - 1) * limit - total - wasted
        if slack < 0 or bins + lower_bound(left, limit) >= used:
            return []
        largest = max(left)
        take((largest,), 1)
        lengths = [k for k in sorted(left, reverse=True) if k <= limit - largest]
        fillings = _fillings(left, lengths, limit - largest, slack, width)
        take((largest,), -1)
        out = []
        for filling in fillings:
            times = min(left[k] // n for k, n in Counter((largest, *filling)).items())
            waste = limit - largest - sum(filling)
            if waste:
                times = max(1, min(times, slack // waste))
            out.append(((largest, *filling), times))
        return out

    ways = [iter(choices())] if left and used > bound else []
    while ways and nodes and used > bound:
        chosen = next(ways[-1], None)
        if chosen is None:
            ways.pop()
            if path:
                filling, times = path.pop()
                take(filling, -times)
                bins, wasted = bins - times, wasted - (limit - sum(filling)) * times
            continue
        filling, times = chosen
        take(filling, times)
        path.append(chosen)
        bins, wasted = bins + times, wasted + (limit - sum(filling)) * times
        if left:
            nodes -= 1
            ways.append(iter(choices()))
            continue
        if bins < used:
            incumbent, used = list(path), bins
        ways.append(iter(()))
    return incumbent


def pack(docs: DataFrame, vocabulary: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of all documents with their sequence and place.

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A document's ids
    are followed by ``end_id``; a null or empty text is that id alone. Documents above
    ``limit`` are cut into pieces of ``limit``, the first the shorter one. Repeated rows
    are packed each; an empty table gives no rows.
    """
    parts = stage(pieces(docs, vocabulary, limit, end_id), "pieces")
    per_task = parts.groupBy("length", "task").agg((F.max("number") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    per_task = stage(per_task.select("length", "task", "n", before.alias("before")), "per_task")
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, sequence = [], 0
    taken: Counter[int] = Counter()
    for filling, times in plan(counts, limit):
        offset = 0
        for length, many in Counter(filling).items():
            slots.append((length, taken[length], many, sequence, offset))
            taken[length] += many * times
            offset += length * many
        sequence += times
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
    starts = (table[:, 0] << 44) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            slot = table[np.searchsorted(starts, (length << 44) + rank, side="right") - 1]
            turn, spot = np.divmod(rank - slot[:, 1], slot[:, 2])
            columns = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(slot[:, 3] + turn), pa.array(slot[:, 4] + spot * length)], names)

    ranked = parts.join(per_task.drop("n"), ["length", "task"]).withColumn("rank", F.col("number") + F.col("before"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)
