"""N-gram Jaccard self-join by parity sketches.

A document is the set of its word shingles. In each size band the shingles fall into
blocks by hash, and a block holds the XOR of its shingles' hashes: a parity sketch. A
shingle that only one of two sets has changes one block, so the number of differing
blocks never exceeds the symmetric difference, and by the pigeonhole principle sets
whose difference is below the number of blocks agree in a block. Pairs are therefore
sought among the sets that agree in a block of the same band, the sketches' distance
drops most of them, and the full sets decide the rest.

Bands of up to 224 shingles use every block. Larger ones would need as many rows as a
third of the shingles for a certain hit; there the first 64 of n / 3.5 blocks are used.
At the threshold each of them agrees with a probability of 0.35, so all 64 miss with
1e-12, and fewer than four agree with 3e-9: of the order of hash collisions. A second
sketch of up to 128 blocks, a byte each, tells most of the other pairs apart: similar
sets agree in 38 or more on average and in fewer than ten with about 1e-8.

Pairs inside a component already found are not looked at again. So a group of near
copies of any size costs about one verified pair per member, and not all its pairs.
What is left then are components whose members resemble each other a little below the
threshold. Each pair of them has to be refuted from its full sets, but none becomes a row:
the components that pairs connect are gathered with their full sets, and compared there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtrail.llm import hashing
from logtrail.llm.components import components
from logtrail.llm.tables import id_and_text, stage

WIDTH = 5
BLOCKS = 64
DIGESTS = 128
_PER_BLOCK = 3.5
_SMALL = 64
_LEAST_SHARED = 4
_LEAST_AGREEING = 10
#: Rows of a key up to which its pairs are compared together with those of other keys.
_FEW = 48
_STEP = np.log(4 / 3)
#: Sets and shingles of a block of full sets that are compared in one task.
_BLOCK_SETS = 4096
_BLOCK_SHINGLES = 1 << 21
_COLUMNS = 1024
_CELLS = 1 << 22
#: Of a document number's hash, the bits that a map of the asked numbers tells apart.
MAP_BITS = 24


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence if there are fewer words; none without words."""
    words = hashing.words(text)
    if not len(words):
        return words
    return np.unique(hashing.windows(words, min(width, len(words)))) ^ np.uint64(0 if len(words) >= width else len(words))


def identity(shingles: np.ndarray) -> int:
    """A 64-bit name of the set."""
    return int(hashing.mix(shingles + np.uint64(len(shingles))).sum(dtype=np.uint64).view(np.int64))


def band_of(size: int) -> int:
    """Sets that can reach a similarity of 0.75 are in the same band or in neighbouring ones."""
    return int(np.floor(np.log(size) / _STEP + 1e-9))


def _blocks(shingles: np.ndarray, count: int, used: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``count`` blocks the first ``used`` that are not empty, and the XOR of the hashes in each."""
    block = ((shingles >> np.uint64(32)) % np.uint64(count)).astype(np.int64)
    if used < count:
        inside = block < used
        shingles, block = shingles[inside], block[inside]
    order = np.argsort(block, kind="stable")
    block, shingles = block[order], shingles[order]
    if not len(block):
        return block, shingles
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    return block[first], np.bitwise_xor.reduceat(shingles, first)


def sketch(shingles: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of the used blocks that are not empty, and a byte per block of the second sketch, 0 for empty."""
    largest = (4 / 3) ** (band + 1)
    wide = int(np.ceil(largest / _PER_BLOCK))
    count = 4 * _SMALL if largest <= _SMALL else max(BLOCKS, wide)
    block, values = _blocks(shingles, count, 4 * _SMALL if largest <= _SMALL else BLOCKS)
    keys = hashing.mix(values + hashing.mix((block + (band << 20)).astype(np.uint64)))
    digests = np.zeros(DIGESTS, dtype=np.uint8)
    block, values = _blocks(shingles, max(DIGESTS, wide), DIGESTS)
    digests[block] = (hashing.mix(values) | np.uint64(1)).astype(np.uint8)
    # the last bit of a key tells which of a set's two bands it is of
    return (keys & ~np.uint64(1) | np.uint64(band & 1)).view(np.int64), digests


_SKETCHED = pa.schema(
    [
        ("doc_id", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64()), ("band", pa.int32()),
        ("low", pa.binary()), ("high", pa.binary()), ("keys", pa.list_(pa.int64())),
    ]
)


def sketched(docs: DataFrame) -> DataFrame:
    """A row per document with its set's identity, size, sketches in its two bands, and join keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                s = shingle_set(text.as_py() or b"")
                if not len(s):
                    rows.append((doc_id, None, 0, None, None, None, None))
                    continue
                set_id = identity(s)
                band = band_of(len(s))
                (k0, low), (k1, high) = sketch(s, band), sketch(s, band + 1)
                rows.append((doc_id, set_id, len(s), band, low.tobytes(), high.tobytes(), np.concatenate((k0, k1))))
            columns = list(zip(*rows, strict=True)) or [[]] * len(_SKETCHED)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _SKETCHED, strict=True)], schema=_SKETCHED)

    return id_and_text(docs).mapInArrow(run, "doc_id long, set_id long, n long, band int, low binary, high binary, keys array<long>")


def shared_keys(rows: DataFrame) -> DataFrame:
    """``key, set_id, lead`` for keys that several sets have; the lead is the smallest of them."""
    ordered = rows.select(F.explode("keys").alias("key"), "set_id").repartition("key").sortWithinPartitions("key", "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key0 = set0 = lead0 = None
        told = False  # whether the lead of the open key was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            key, member = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new_key = np.concatenate(([key[0] != key0], key[1:] != key[:-1]))
            new_set = new_key | np.concatenate(([member[0] != set0], member[1:] != member[:-1]))
            begins = np.flatnonzero(new_key)
            lead = np.empty(len(key), dtype=np.int64)
            group = np.cumsum(new_key)
            leads = np.concatenate(([lead0 if lead0 is not None else 0], member[begins]))
            lead = leads[group]
            follow = new_set & ~new_key
            out_key, out_set, out_lead = key[follow], member[follow], lead[follow]
            has = np.unique(group[follow])
            fresh = has[(has > 0) | (not told)] if len(has) else has
            index = np.where(fresh > 0, begins[np.maximum(fresh, 1) - 1] if len(begins) else 0, 0)
            keys = np.where(fresh > 0, key[index], key0 if key0 is not None else 0).astype(np.int64)
            told = (told if group[-1] == 0 else False) or bool(len(has) and has[-1] == group[-1])
            key0, set0, lead0 = key[-1], member[-1], lead[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((out_key, keys))), pa.array(np.concatenate((out_set, leads[fresh]))), pa.array(np.concatenate((out_lead, leads[fresh])))],
                ["key", "set_id", "lead"],
            )

    return ordered.mapInArrow(run, "key long, set_id long, lead long")


def _similar(same: np.ndarray, empty: np.ndarray, sizes: np.ndarray, band) -> tuple[np.ndarray, np.ndarray]:
    """Agreeing blocks, of those equal and those empty in both, and whether sets of this joint size can be similar enough."""
    agree = same - empty
    largest = (4 / 3) ** (band + 1)
    # with all shingles in the blocks, no more blocks can differ than shingles may
    possible = (largest > DIGESTS * _PER_BLOCK) | (DIGESTS - same <= sizes // 7)
    return agree, possible & ((largest <= _SMALL) | (agree >= _LEAST_AGREEING))


def _pairs_of_small(sketches: np.ndarray, sizes: np.ndarray, band: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The similar pairs (rows, agreeing blocks) within groups of few rows; ``ends`` is each row's end of group."""
    found = []
    place = np.arange(len(ends))
    for apart in range(1, int((ends - place).max(initial=1))):
        x = np.flatnonzero(place + apart < ends)
        y = x + apart
        a, b = sketches[x], sketches[y]
        same = (a == b).sum(axis=1)
        agree, ok = _similar(same, ((a | b) == 0).sum(axis=1), sizes[x] + sizes[y], band[x])
        found.append((x[ok], y[ok], agree[ok]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (place[:0],) * 3


def _pairs_of_large(sketches: np.ndarray, sizes: np.ndarray, band: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of one large group the first row, agreeing blocks and similarity of strips of the matrix of all rows against all."""
    by_block = np.ascontiguousarray(sketches.T)
    empty = (sketches == 0).astype(np.float32)
    strip = max(1, (1 << 20) // len(sizes))
    for i in range(0, len(sizes), strip):
        j = slice(i, i + strip)
        same = np.zeros((len(sizes[j]), len(sizes)), dtype=np.uint8)
        for values in by_block:
            same += values[j, None] == values[None, :]
        agree, ok = _similar(same.astype(np.int16), (empty[j] @ empty.T).astype(np.int16), sizes[j, None] + sizes[None, :], band)
        yield i, agree, ok


def _join(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the trees of ``root`` that hold the two ends of each pair; each member points at its tree's smallest one."""
    while len(x):
        one, two = root[x], root[y]
        apart = one != two
        x, y, one, two = x[apart], y[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root != root[root]).any():
            root[:] = root[root]


def _moved(names: np.ndarray, root: np.ndarray) -> list[np.ndarray]:
    """A link for each name that is not the smallest of its tree, to that one."""
    below = np.flatnonzero(root != np.arange(len(root)))
    return [names[below], names[root[below]]]


def close_pairs(shared: DataFrame, nodes: DataFrame, labels: DataFrame | None = None, every: bool = False) -> DataFrame:
    """Pairs ``u > v`` of sets that share a key, may be similar by their sketches and have different labels.

    Of each label the closest pair; with ``every``, pairs of labels instead, by which all labels
    with such a pair are connected, a row per label and batch at most. Without ``labels`` each set is its
    own. Rows of one key are compared in one task, strip by strip; keys whose sets all have one
    label, as most keys of a group of near copies soon do, are left out.
    """
    own = F.pmod("key", F.lit(2)) == F.pmod("band", F.lit(2))
    if labels is None:
        named = shared.select("key", "set_id", F.col("set_id").alias("label"))
    else:
        # the sketches are the bulk of a row, so they are added to the keys that are left
        named = shared.select("key", "set_id").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").select("key", "set_id", F.coalesce("label", "set_id").alias("label"))
        of_key = Window.partitionBy("key")
        named = named.withColumns({"_least": F.min("label").over(of_key), "_most": F.max("label").over(of_key)}).filter("_least <> _most")
    rows = named.select("key", "set_id", "label").join(nodes.select("set_id", "n", "band", "low", "high"), "set_id")
    band, chosen = F.when(own, F.col("band")).otherwise(F.col("band") + 1), F.when(own, F.col("low")).otherwise(F.col("high"))
    ordered = rows.select("key", "set_id", "label", "n", band.alias("band"), chosen.alias("sketch")).repartition("key").sortWithinPartitions("key")

    def best(u: np.ndarray, v: np.ndarray, agree: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """The closest pair of each label."""
        order = np.lexsort((-agree, label))
        order = order[np.concatenate(([True], label[order][1:] != label[order][:-1]))] if len(order) else order
        return [u[order], v[order], agree[order], label[order]]

    def small(ids, label, sizes, band, sketches, ends) -> list[np.ndarray]:
        x, y, agree = _pairs_of_small(sketches, sizes, band, ends)
        keep = label[x] != label[y]
        x, y, agree = x[keep], y[keep], agree[keep]
        if every:
            names, at = np.unique(label, return_inverse=True)
            root = np.arange(len(names))
            _join(root, at[x], at[y])
            return _moved(names, root)
        return best(np.append(ids[x], ids[y]), np.append(ids[y], ids[x]), np.append(agree, agree), np.append(label[x], label[y]))

    def large(ids, label, sizes, band, sketches) -> Iterator[list[np.ndarray]]:
        names, at = np.unique(label, return_inverse=True)
        root = np.arange(len(names))
        for i, agree, ok in _pairs_of_large(sketches, sizes, band[0]):
            tree = root[at]  # labels that are connected need no further pair
            ok &= tree[i : i + len(ok), None] != tree[None, :]
            if every:
                x, y = np.nonzero(ok)
                _join(root, at[x + i], at[y])
                continue
            agree = np.where(ok, agree, -1)
            y = agree.argmax(axis=1)
            x = np.flatnonzero(agree[np.arange(len(y)), y] >= 0)
            y = y[x]
            yield best(ids[x + i], ids[y], agree[x, y], label[x + i])
        if every:
            yield _moved(names, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, *columns in _whole_groups(batches):
            begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            counts = np.diff(np.append(begins, len(key)))
            few = np.repeat(counts <= _FEW, counts)
            ends = np.cumsum(np.where(counts <= _FEW, counts, 0))
            found = [small(*(c[few] for c in columns), np.repeat(ends[counts <= _FEW], counts[counts <= _FEW]))]
            for begin, count in zip(begins[counts > _FEW], counts[counts > _FEW], strict=True):
                found += large(*(c[begin : begin + count] for c in columns))
            u, v, *rest = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(u):
                out = [np.maximum(u, v), np.minimum(u, v), *(c.astype(np.int64) for c in rest)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["u", "v", "agree", "label"][: len(out)])

    if every:
        return ordered.mapInArrow(run, "u long, v long").distinct()
    found = ordered.mapInArrow(run, "u long, v long, agree long, label long")
    best = found.groupBy("label").agg(F.max(F.struct("agree", "u", "v")).alias("best"))
    return best.select("best.u", "best.v").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Sorted batches as arrays (the last column as sketches), cut so that no run of the first column is split."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        sketches = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), dtype=np.uint8).reshape(-1, DIGESTS)
        columns = [*(c.to_numpy() for c in batch.columns[:-1]), sketches]
        key = columns[0]
        cut = int(np.searchsorted(key, key[-1]))
        if cut or held and held[-1][0][-1] != key[-1]:
            held.append([c[:cut] for c in columns])
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _of_numbers(numbers: DataFrame) -> Column:
    """Whether a document number may be among the column ``rep``: a bit map of 2**24 bits, folded by Spark."""
    slot = F.xxhash64("rep").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    got = numbers.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    known = words.view(np.uint8)

    @F.pandas_udf("boolean")
    def maybe(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series(known[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    return maybe(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << MAP_BITS) - 1)))


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``set_id, shingles`` of the nodes, from the text of one of their documents.

    Only texts whose number may be that of a node's document are joined, so most texts are not shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            meant = [len(s) > 0 and identity(s) == i for s, i in zip(sets, batch.column(0).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.view(np.int64) for s in sets], type=pa.list_(pa.int64()))], ["set_id", "shingles"]
            )
            yield out.filter(pa.array(meant, type=pa.bool_()))

    # a repeated document number may carry another text, which is then not the set that is meant
    reps = nodes.select("set_id", F.col("rep").alias("doc_id"))
    texts = id_and_text(docs).filter(_of_numbers(nodes)).join(reps, "doc_id").select("set_id", "text")
    return texts.mapInArrow(run, "set_id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of the pairs those whose full sets have ``100 * intersection >= threshold * union``."""
    one, two = (sets.select(F.col("set_id").alias(s), F.col("shingles").alias(f"set_{s}")) for s in ("u", "v"))
    both = F.size(F.array_intersect("set_u", "set_v"))
    return pairs.join(one, "u").join(two, "v").filter(100 * both >= threshold * (F.size("set_u") + F.size("set_v") - both)).select("u", "v").distinct()


def _shared_counts(rows: slice, word: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """How many words each of some owners shares with each of all ``count``; entries in order of their words.

    Words of many owners are counted by products of matrices, the others by the lists of their owners.
    """
    held = np.bincount(word)
    common = held * 16 >= count
    out = np.zeros((rows.stop - rows.start, count), dtype=np.int64)
    column = np.cumsum(common) - 1
    dense = common[word]
    at, by = column[word[dense]], owner[dense]
    for low in range(0, int(common.sum()), _COLUMNS):
        some = slice(*np.searchsorted(at, (low, low + _COLUMNS)))
        cells = np.zeros((count, _COLUMNS), dtype=np.float32)
        cells[by[some], at[some] - low] = 1
        out += (cells[rows] @ cells.T).astype(np.int64)
    first = np.cumsum(held) - held
    asked = np.flatnonzero(~dense & (owner >= rows.start) & (owner < rows.stop))
    ends = np.cumsum(held[word[asked]])
    done = 0
    while done < len(asked):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _CELLS)))
        some = asked[done:upto]
        many = held[word[some]]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[word[some]], many)
        cell = np.repeat(owner[some] - rows.start, many) * count + owner[place]
        out += np.bincount(cell, minlength=out.size).reshape(out.shape)
        done = upto
    return out


def _linked(label: np.ndarray, inner: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, threshold: int) -> list[np.ndarray]:
    """Links that connect the labels of sets similar to ``threshold``: of all pairs, or of those of an inner and an outer set."""
    names, at = np.unique(label, return_inverse=True)
    root = np.arange(len(names))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    fresh = np.concatenate(([True], shingles[1:] != shingles[:-1]))
    begins, word = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    # shingles of one label only are in no intersection that is asked for, and a set needs enough of the others
    asked = (np.minimum.reduceat(at[owner], begins) != np.maximum.reduceat(at[owner], begins))[word]
    able = 100 * np.bincount(owner[asked], minlength=len(sizes)) >= threshold * sizes
    asked &= able[owner]
    left = np.flatnonzero(able)
    if len(left) < 2:
        return _moved(names, root)
    at, inner, sizes = at[left], inner[left], sizes[left]
    owner = (np.cumsum(able) - 1)[owner[asked]]
    word = np.unique(word[asked], return_inverse=True)[1]
    strip = max(1, _CELLS // len(left))
    for low in range(0, len(left) if len(word) else 0, strip):
        rows = slice(low, min(low + strip, len(left)))
        both = _shared_counts(rows, word, owner, len(left))
        ok = 100 * both >= threshold * (sizes[rows, None] + sizes[None, :] - both)
        ok &= root[at[rows], None] != root[at]
        if not inner.all():
            ok &= inner[rows, None] != inner[None, :]
        x, y = np.nonzero(ok)
        _join(root, at[x + low], at[y])
    return _moved(names, root)


def linked_labels(labels: DataFrame, connected: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links ``u, v`` between labels that have similar sets, within the groups of labels that ``connected`` pairs make.

    All sets of a group are compared in full in one task. A group of more than a block is dealt into blocks, a
    task for each two of them, but for two of the group's largest label; each task gives a row per label at most, whatever the pairs.
    """
    groups = components(connected).select(F.col("node").alias("label"), F.col("label").alias("family"))
    members = sets.select(F.col("set_id"), F.size("shingles").alias("n")).join(labels.withColumnRenamed("node", "set_id"), "set_id").join(groups, "label")
    by_label = members.groupBy("family", "label").agg(F.count("*").alias("count"), F.sum("n").alias("sum"))
    sums = by_label.groupBy("family").agg(F.max(F.struct("count", "sum", "label")).alias("lead"), F.sum("count").alias("count"), F.sum("sum").alias("sum"))

    def blocks(count: Column, size: Column) -> Column:
        return F.greatest(F.ceil(count / _BLOCK_SETS), F.ceil(size / _BLOCK_SHINGLES)).cast("int")

    one, lead = blocks(F.col("count"), F.col("sum")) == 1, F.col("lead")
    rest = F.when(one, 1).otherwise(blocks(F.col("count") - lead["count"], F.col("sum") - lead["sum"]))
    sums = sums.select("family", F.when(~one, lead["label"]).alias("lead"), rest.alias("rest"), F.when(one, 0).otherwise(blocks(lead["count"], lead["sum"])).alias("leads"))
    leading, at = F.col("label").eqNullSafe(F.col("lead")), F.xxhash64("set_id")
    block = F.when(leading, F.col("rest") + F.pmod(at, F.col("leads"))).otherwise(F.pmod(at, F.col("rest"))).cast("int")
    others = F.sequence(F.lit(0), F.col("rest") - 1 + F.when(leading, 0).otherwise(F.col("leads")))
    dealt = members.join(sums, "family").select("set_id", "family", "label", block.alias("block"), F.explode(others).alias("other"))
    keys = ["family", "one", "two"]
    rows = dealt.select("set_id", "family", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "label", (F.col("block") <= F.col("other")).alias("inner"))
    full = rows.join(sets, "set_id").select(*keys, "label", "inner", "shingles").repartition(*keys).sortWithinPartitions(*keys)

    def compare(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        label, inner = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (3, 4))
        sizes = np.concatenate([b.column(5).value_lengths().to_numpy() for b in held]).astype(np.int64)
        shingles = np.concatenate([b.column(5).flatten().to_numpy() for b in held])
        u, v = _linked(label, inner, sizes, shingles, threshold)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            begins = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
            for begin, end in zip(begins, np.append(begins[1:], batch.num_rows), strict=True):
                if held and tuple(key[:, begin]) != last:
                    yield compare(held)
                    held = []
                held.append(batch.slice(begin, end - begin))
                last = tuple(key[:, begin])
        if held:
            yield compare(held)

    return full.mapInArrow(run, "u long, v long")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` after the labels at the ends of each link have become one."""
    ends = links
    for end in ("u", "v"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end)
    return relabelled(labels, ends.select(F.col("label_u").alias("u"), F.col("label_v").alias("v")))


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` after linked labels have become one."""
    moves = components(links)
    moved = labels.join(moves.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return stage(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")


def similar_groups(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    The component is named by the smallest document number that links of a similarity of
    ``threshold`` per cent or more reach. Null, empty and blank texts have no shingles
    and only themselves; equal sets are one node, whatever their number. ``threshold``
    below 75 is refused, as the bands would not hold it. An empty table gives no rows.
    """
    if threshold < 75:
        raise ValueError("the size bands are made for a threshold of 75 or more")
    rows = stage(sketched(docs), "sketched")
    nodes = stage(
        rows.filter("n > 0").groupBy("set_id").agg(
            F.first("n").alias("n"), F.first("band").alias("band"), F.first("low").alias("low"), F.first("high").alias("high"), F.min("doc_id").alias("rep")
        ),
        "nodes",
    )
    shared = stage(shared_keys(rows.filter("n > 0")), "shared")
    # similar sets share several keys, so one that shares fewer with all others together has no partner
    likely = shared.groupBy("set_id").count().join(nodes, "set_id").filter((F.col("count") >= _LEAST_SHARED) | (F.col("n") <= _SMALL))
    likely = stage(likely.drop("count"), "likely")
    shared = stage(shared.join(likely.select("set_id"), "set_id"), "shared")
    tried = stage(close_pairs(shared, likely), "pairs")
    # a set that is close to none needs no further look
    alive = tried.select(F.col("u").alias("set_id")).union(tried.select(F.col("v").alias("set_id"))).distinct()
    likely = stage(likely.join(alive, "set_id", "left_semi"), "alive")
    shared = stage(shared.join(alive, "set_id", "left_semi"), "shared")
    sets = stage(full_sets(docs, likely), "sets")
    labels = likely.select(F.col("set_id").alias("node"), F.col("set_id").alias("label"))
    labels = merged(labels, verified(tried, sets, threshold))
    # components join along their closest pairs, round by round, which leaves few; then all sets of those left
    for _ in range(2):
        pairs = stage(close_pairs(shared, likely, labels).join(tried, ["u", "v"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        asked = pairs.select(F.col("u").alias("set_id")).union(pairs.select(F.col("v").alias("set_id"))).distinct()
        labels = merged(labels, verified(pairs, sets.join(asked, "set_id", "left_semi"), threshold))
        tried = tried.union(pairs)
    connected = stage(close_pairs(shared, likely, labels, every=True), "connected")
    if not connected.isEmpty():
        labels = relabelled(labels, linked_labels(labels, connected, sets, threshold))
    named = nodes.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    named = stage(named.select("set_id", "label", "rep"), "named")
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    names = stage(named.join(smallest, "label").select("set_id", "component_id"), "names")
    return rows.select("doc_id", "set_id", F.col("n").alias("n_shingles")).join(names, "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
