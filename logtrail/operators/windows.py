"""Greedy anchored windows, the core of the burst detectors.

Per key, a row is an *anchor* when at least ``threshold`` rows, itself included,
lie within ``window_seconds`` after it (inclusive). The first anchor opens a
window that takes all rows up to its end; the next window opens at the first
anchor after that end. This is neither a tumbling, sliding nor session window.

Three facts make it a Spark job:

* a row is an anchor if and only if the row ``threshold - 1`` places later is
  still inside the window, so ``lead`` decides it without counting;
* a window is known by the time of its anchor alone: equal times are taken or
  passed over together;
* two windows of a key start more than ``window_seconds`` apart, so each cell of
  the window's width holds at most one start, and members find their window
  through an equi-join on (key, cell).

Keys whose rows fit in one group use a window function and a fold over the anchor
times. Larger ones are ranked globally and worked on in blocks of equal size, and
the windows are picked by pointer halving, where every step is an equi-join on
(key, anchor time); such keys are unique, so no task gets a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtrail.operators.ordering import in_blocks, with_ordinal
from logtrail.session import stage

GROUP_ROWS = 1_000_000
FOLD_ANCHORS = 10_000
BLOCK_ROWS = 1_000_000


def micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


def anchors_by_key(rows: DataFrame, width: int, threshold: int) -> DataFrame:
    """Distinct anchor times per key; for keys that fit in one group."""
    by_key = Window.partitionBy("key").orderBy("t", "event_idx")
    ahead = F.lead("t", threshold - 1).over(by_key)
    looked = rows.select("key", "t", "event_idx", (ahead - F.col("t") <= width).alias("is_anchor"))
    return _distinct_times(looked.filter("is_anchor"))


def _distinct_times(anchors: DataFrame) -> DataFrame:
    """One row per key and time, with the first of the rows at that time."""
    return anchors.groupBy("key", "t").agg(F.min("event_idx").alias("first_idx"))


def anchors_in_blocks(rows: DataFrame, width: int, threshold: int, block_rows: int) -> DataFrame:
    """The same for keys of any size: rank by (key, time), then look ahead inside blocks."""
    order = [F.col("key"), F.col("t"), F.col("event_idx")]
    ranked = with_ordinal(rows.select("key", "t", "event_idx"), order, "rn", "burst-rows")
    by_block = Window.partitionBy("_block").orderBy("rn")
    looked = in_blocks(ranked, "rn", block_rows, threshold - 1).select(
        "key",
        "t",
        "event_idx",
        "_margin",
        F.lead("key", threshold - 1).over(by_block).alias("key_ahead"),
        F.lead("t", threshold - 1).over(by_block).alias("t_ahead"),
    )
    same_key = F.col("key_ahead") == F.col("key")
    return _distinct_times(looked.filter(~F.col("_margin") & same_key & (F.col("t_ahead") - F.col("t") <= width)))


def pick_by_fold(anchors: DataFrame, width: int) -> DataFrame:
    """Window starts of keys with few anchors: one pass over the sorted times."""
    never = -(1 << 62)
    anchor = "struct<t: bigint, first_idx: bigint>"
    folded = F.aggregate(
        F.col("anchors"),
        F.struct(F.lit(never).alias("end"), F.array().cast(f"array<{anchor}>").alias("starts")),
        lambda acc, a: F.when(
            a["t"] > acc["end"],
            F.struct((a["t"] + F.lit(width)).alias("end"), F.concat(acc["starts"], F.array(a)).alias("starts")),
        ).otherwise(acc),
        lambda acc: acc["starts"],
    )
    per_key = anchors.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("t", "first_idx"))).alias("anchors"))
    return per_key.select("key", F.explode(folded).alias("a")).select("key", F.col("a.t").alias("start"), "a.first_idx")


def _neighbours(anchors: DataFrame, width: int, block_rows: int) -> DataFrame:
    """Per anchor: the previous anchor of the key and the first one after the window's end.

    Anchors and window ends are ranked together; the next anchor at or after an end
    is filled backwards inside blocks, and across blocks from the first anchor of
    each later block.
    """
    marks = anchors.select("key", F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("of"))
    ends = anchors.select("key", (F.col("t") + width + 1).alias("at"), F.lit(0).alias("kind"), F.col("t").alias("of"))
    order = [F.col("key"), F.col("at"), F.col("kind"), F.col("of")]
    ranked = with_ordinal(marks.unionByName(ends), order, "rn", "burst-ends").withColumn(
        "_block", F.floor(F.col("rn") / block_rows).cast("bigint")
    )
    anchor = F.when(F.col("kind") == 1, F.struct("key", F.col("at").alias("t")))
    after = Window.partitionBy("_block").orderBy(F.desc("rn")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_block").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    local = ranked.select(
        "*",
        F.last(anchor, ignorenulls=True).over(after).alias("next_here"),
        F.last(anchor, ignorenulls=True).over(before).alias("prev_here"),
    )
    # One row per block.
    blocks = ranked.groupBy("_block").agg(
        F.min_by(anchor, F.when(F.col("kind") == 1, F.col("rn"))).alias("first_anchor"),
        F.max_by(anchor, F.when(F.col("kind") == 1, F.col("rn"))).alias("last_anchor"),
    )
    down = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        "_block",
        F.last("first_anchor", ignorenulls=True).over(down).alias("next_later"),
        F.last("last_anchor", ignorenulls=True).over(up).alias("prev_earlier"),
    )
    filled = local.join(carried, "_block").select(
        "key",
        "at",
        "kind",
        "of",
        F.coalesce("next_here", "next_later").alias("nxt"),
        F.coalesce("prev_here", "prev_earlier").alias("prv"),
    )

    def same_key(c: str) -> Column:
        return F.when(F.col(f"{c}.key") == F.col("key"), F.col(f"{c}.t"))

    previous = filled.filter("kind = 1").select("key", F.col("at").alias("t"), same_key("prv").alias("prev"))
    following = filled.filter("kind = 0").select("key", F.col("of").alias("t"), same_key("nxt").alias("to"))
    return previous.join(following, ["key", "t"])


def pick_by_halving(anchors: DataFrame, width: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Window starts of keys with any number of anchors.

    Time is cut into cells of ``width + 1`` microseconds, and at level k into
    superblocks of 2**k cells. ``to`` leads from an anchor to the first start that
    a chain through it has outside its superblock; going one level up it takes at
    most one more hop. Only anchors that can be the first start of a superblock are
    needed at the next level: those whose previous anchor lies less than a window
    after the superblock began. So the tables shrink by half per level. Going down
    again, each superblock's first start yields that of its second half.
    """
    cell = width + 1
    levels = [stage(_neighbours(anchors, width, block_rows), "burst-level0")]
    low, high = levels[0].agg(F.min("t"), F.max("t")).first()
    if low is None:
        return anchors.select("key", F.col("t").alias("start"), "first_idx")

    def superblock(t: Column | str, level: int) -> Column:
        t = F.col(t) if isinstance(t, str) else t
        return F.floor((t - F.lit(low)) / F.lit(cell << level)).cast("bigint")

    while (cell << (len(levels) - 1)) <= high - low:
        level = len(levels)
        below = levels[-1]
        began = superblock("t", level) * F.lit(cell << level) + F.lit(low)
        entries = below.filter(F.col("prev").isNull() | (F.col("prev") < began + width))
        hop = below.select("key", F.col("t").alias("to"), F.col("to").alias("hop_to"))
        inside = superblock("to", level) == superblock("t", level)
        climbed = entries.join(hop, ["key", "to"], "left").select(
            "key", "t", "prev", F.when(inside, F.col("hop_to")).otherwise(F.col("to")).alias("to")
        )
        levels.append(stage(climbed, f"burst-level{level}"))

    starts = levels[-1].filter("prev IS NULL").select("key", "t")
    for level in range(len(levels) - 1, 0, -1):
        inside = superblock("to", level) == superblock("t", level)
        steps = levels[level - 1].filter(inside).select("key", "t", "to")
        second_half = starts.join(steps, ["key", "t"]).select("key", F.col("to").alias("t"))
        starts = stage(starts.unionByName(second_half), "burst-starts")
    return anchors.join(starts, ["key", "t"]).select("key", F.col("t").alias("start"), "first_idx")


def largest_key(rows: DataFrame) -> int:
    """Number of rows of the largest key; decides which way is planned."""
    return rows.filter("t IS NOT NULL").groupBy("key").count().agg(F.max("count")).first()[0] or 0


def greedy_windows(
    rows: DataFrame,
    window_seconds: float,
    threshold: int,
    largest: int | None = None,
    group_rows: int = GROUP_ROWS,
    fold_anchors: int = FOLD_ANCHORS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Starts of the greedy windows: ``key``, ``start`` (microseconds), ``first_idx``.

    ``rows`` has ``key``, ``t`` (microseconds) and ``event_idx``; rows without a
    time belong to no window. The size of the ``largest`` key is measured first
    unless given, and decides which of the exact ways is planned.
    """
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    width = micros(window_seconds)
    timed = rows.filter("t IS NOT NULL").select("key", "t", "event_idx")
    largest = largest_key(rows) if largest is None else largest
    if largest <= group_rows:
        anchors = anchors_by_key(timed, width, threshold)
    else:
        anchors = anchors_in_blocks(timed, width, threshold, block_rows)
    if largest <= fold_anchors:
        return pick_by_fold(anchors, width)
    anchors = stage(anchors, "burst-anchors")
    most = anchors.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    return pick_by_fold(anchors, width) if most <= fold_anchors else pick_by_halving(anchors, width, block_rows)


def window_members(rows: DataFrame, starts: DataFrame, window_seconds: float) -> DataFrame:
    """``rows`` that lie in a window, with its ``start`` and ``first_idx``.

    A window reaches into its own cell and the next, so its start is sent to both.
    """
    width = micros(window_seconds)

    def cell(t: str) -> Column:
        return F.floor(F.col(t) / (width + 1)).cast("bigint")

    own = cell("start")
    reach = starts.select("key", "start", "first_idx", F.explode(F.array(own, own + 1)).alias("_cell"))
    joined = rows.filter("t IS NOT NULL").withColumn("_cell", cell("t")).join(reach, ["key", "_cell"])
    inside = (F.col("t") >= F.col("start")) & (F.col("t") <= F.col("start") + width)
    return joined.filter(inside).drop("_cell")
