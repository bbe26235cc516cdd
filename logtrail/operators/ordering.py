"""Global order without a single-task window.

Everything here rests on one range-partitioned sort. Range boundaries are drawn
over the whole sort key, so partitions stay even when one key or one second holds
a third of the rows. The sorted rows are staged once with the partition number and
the position in the partition; the dense rank is then position + rows before the
partition, and the only thing that is collected is one count per partition.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtrail.session import stage

_POSITION_BITS = 33
TIMELINE_ORDER = ("timestamp", "file_seq", "source_file", "row_no")


def with_ordinal(df: DataFrame, order: list[Column], name: str, label: str, partitions: int | None = None) -> DataFrame:
    """Add ``name``: the dense 0-based rank of each row under ``order``, as a staged table.

    ``order`` should be unique per row; ties get different ranks in an arbitrary
    but, being staged, stable order.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    staged = stage(
        placed.select(
            *df.columns,
            F.shiftright("_place", _POSITION_BITS).alias("_part"),
            F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_pos"),
        ),
        label,
    )
    # One row per partition of the sort, so its size is bounded by the partition count.
    counts = sorted((r["_part"], r["n"]) for r in staged.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts = [0, *accumulate(n for _, n in counts)][: len(counts)]
    offsets = df.sparkSession.createDataFrame(
        pa.table({"_part": pa.array([p for p, _ in counts], pa.int64()), "_start": pa.array(starts, pa.int64())})
    )
    return staged.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_start") + F.col("_pos")).alias(name)
    )


def staged_order(df: DataFrame, order: list[Column], label: str) -> tuple[DataFrame, list[tuple[int, int]], int]:
    """Rows in a folder per range of the order, with ``_range`` and ``_pos`` in it; each range and its first place; the number of rows.

    A filter on ``_range`` prunes folders, so reading some rows of the order opens the files of their range only.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = ranged.select(
        *df.columns,
        F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_pos"),
        F.shiftright("_place", _POSITION_BITS).alias("_range"),
    )
    staged = stage(placed, label, "_range")
    # one row per range of the sort
    counts = sorted((r["_range"], r["n"]) for r in staged.groupBy("_range").agg(F.count("*").alias("n")).collect())
    starts = [0, *accumulate(n for _, n in counts)]
    return staged, [(number, start) for (number, _), start in zip(counts, starts, strict=False)], starts[-1]


def union_sources(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name; columns that a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def build_timeline(*frames: DataFrame, partitions: int | None = None, stage_first: bool = False) -> DataFrame:
    """Merge event frames into one chronological table with a dense ``event_idx``.

    Events without a time come first; equal times keep the order of file and row.
    The result is staged, because six detectors and the explorer read it. A range
    sort runs its input twice, once to sample the boundaries; ``stage_first``
    writes events that are still to be parsed before that, so they are parsed once.
    """
    merged = union_sources(*frames)
    merged = stage(merged, "events") if stage_first else merged
    order = [F.asc_nulls_first(c) for c in TIMELINE_ORDER if c in merged.columns]
    return with_ordinal(merged, order, "event_idx", "timeline", partitions)


def in_blocks(ordered: DataFrame, ordinal: str, block_rows: int, ahead: int) -> DataFrame:
    """Cut ranked rows into blocks of ``block_rows``, each with the next ``ahead`` rows as a margin.

    Adds ``_block`` and ``_margin``. A window over ``_block`` then sees, for every
    row that is not margin, all of the ``ahead`` rows that follow it.
    """
    block_rows = max(block_rows, ahead)
    block = F.floor(F.col(ordinal) / F.lit(block_rows)).cast("bigint")
    in_margin = (F.col(ordinal) % F.lit(block_rows) < ahead) & (block > 0)
    blocks = F.when(in_margin, F.array(block, block - 1)).otherwise(F.array(block))
    return ordered.select("*", F.explode(blocks).alias("_block")).withColumn("_margin", F.col("_block") != block)


def first_following(
    events: DataFrame, key: str, marks: dict[str, tuple[Column, Column]], segment_rows: int = 100_000
) -> DataFrame:
    """For every row and mark, the value of the next later row of the same key that has the mark.

    ``marks`` maps an output column to (condition, value). Rows are cut into
    segments of the timeline, so a key that holds a third of all rows is spread
    over tasks; what a segment does not find itself it takes from the first mark
    of the following segments of the key, of which there is one per segment.
    """
    segmented = events.withColumn("_seg", F.floor(F.col("event_idx") / segment_rows).cast("bigint"))
    marked = segmented.withColumns({f"_m_{name}": F.when(cond, value) for name, (cond, value) in marks.items()})
    later_rows = Window.partitionBy(key, "_seg").orderBy(F.desc("event_idx")).rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumns({f"_l_{name}": F.last(f"_m_{name}", ignorenulls=True).over(later_rows) for name in marks})

    heads = (
        marked.filter(reduce(lambda a, b: a | b, [F.col(f"_m_{n}").isNotNull() for n in marks]))
        .groupBy(key, "_seg")
        .agg(
            *[
                F.min_by(F.col(f"_m_{n}"), F.when(F.col(f"_m_{n}").isNotNull(), F.col("event_idx"))).alias(f"_h_{n}")
                for n in marks
            ]
        )
    )
    # Every segment of the key that has rows, with the first mark of the segments after it.
    segments = marked.groupBy(key, "_seg").agg(F.count("*").alias("_rows")).join(heads, [key, "_seg"], "left")
    later_segs = Window.partitionBy(key).orderBy(F.desc("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    carried = segments.select(
        key, "_seg", *[F.last(f"_h_{n}", ignorenulls=True).over(later_segs).alias(f"_c_{n}") for n in marks]
    )
    return local.join(carried, [key, "_seg"], "left").select(
        *events.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in marks]
    )
