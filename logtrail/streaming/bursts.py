"""Continuous burst alerts: greedy anchored windows per key over an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logtrail.session import STATE_PROVIDER, STATE_PROVIDER_KEY

BURST_SCHEMA = "key string, start_us long, last_us long, n long, first_idx long"
#: Parts into which the rows of one key and slot are spread before they meet.
SALTS = 8
#: Groups into which the keys are dealt. A batch calls Python once or twice per group, whatever the keys.
GROUPS = 512

Window = tuple[int, int, int, int]


def advance(
    times: np.ndarray, places: np.ndarray, window: Window | None, width: int, threshold: int
) -> tuple[list[Window], Window | None, int]:
    """Windows that rows in time order close, the one left open, and how many rows were used up.

    A window is (start, last, rows, first place). It takes all rows up to ``width`` after its start; the next
    begins at the first row after it that has ``threshold - 1`` rows within ``width`` behind it. Each
    step is a search in sorted numbers, so the work grows with the windows, not with their rows.
    """
    opening = np.flatnonzero(times[threshold - 1 :] - times[: max(len(times) - threshold + 1, 0)] <= width)
    closed, at = [], 0
    while True:
        if window is None:
            k = np.searchsorted(opening, at)
            if k == len(opening):
                return closed, None, at
            at = int(opening[k])
            window = (int(times[at]), int(times[at]), 0, int(places[at]))
        end = int(np.searchsorted(times, window[0] + width, side="right"))
        if end > at:
            window, at = (window[0], int(times[end - 1]), window[2] + end - at, window[3]), end
        if at == len(times):
            return closed, window, at
        closed.append(window)
        window = None


class GreedyWindows(StatefulProcessor):
    """Same windows as the batch operator, in event time, for a group of keys.

    Its rows are slots that the watermark has passed, each with all its times: a slot is never seen
    again and later batches bring later slots. So the state of a key is small, whatever its rows:
    start, count and end of the open window, or the last ``threshold - 1`` rows that could still open one. What
    costs is each call and each access to state, so the keys of a group share both.
    """

    def __init__(self, width_us: int, threshold: int, slot_us: int):
        self.width, self.threshold, self.slot = width_us, threshold, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "key array<string>, t array<long>, idx array<long>")
        self.windows = handle.getValueState("windows", "key array<string>, start array<long>, last array<long>, n array<long>, first_idx array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, t, idx = self.recent.get() or ([], [], [])
        keys, times, places = list(held), [np.array([v], dtype=np.int64) for v in t], [np.array([v], dtype=np.int64) for v in idx]
        for frame in rows:
            keys += frame["key"].tolist()
            times += [v.astype(np.int64) for v in frame["times"]]
            places += [v.astype(np.int64) for v in frame["places"]]
        number = {k: n for n, k in enumerate(dict.fromkeys(keys))}
        names, numbers = list(number), np.array([number[k] for k in keys])
        code, t, idx = np.repeat(numbers, [len(v) for v in times]), np.concatenate(times), np.concatenate(places)
        given = np.zeros(len(names), dtype=bool)
        given[numbers[len(held) :]] = True
        order = np.lexsort((idx, t, code))
        order = order[given[code[order]]]
        begins = np.flatnonzero(np.diff(code[order], prepend=-1))
        windows, closed, left = self._open(), [], [np.flatnonzero(~given[code])]
        for at in np.split(order, begins[1:]):
            name = names[code[at[0]]]
            done, window, used = advance(t[at], idx[at], windows.pop(name, None), self.width, self.threshold)
            closed += [(name, *w) for w in done]
            if window:
                windows[name] = window
            else:
                left.append(at[max(used, len(at) - self.threshold + 1) :])
        passed = self._passed(timerValues)
        left = np.concatenate(left)
        left = left[t[left] + self.width >= passed]
        if len(left):
            self.recent.update(([names[c] for c in code[left]], t[left].tolist(), idx[left].tolist()))
        elif held:
            self.recent.clear()
        yield from self._due(windows, closed, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(self._open(), [], self._passed(timerValues))

    def _passed(self, timerValues) -> int:
        """The end of the last slot that the watermark has passed: rows to come are not before it."""
        return timerValues.getCurrentWatermarkInMs() * 1000 // self.slot * self.slot

    def _open(self) -> dict[str | None, Window]:
        keys, *columns = self.windows.get() or ([],) * 5
        return dict(zip(keys, zip(*columns, strict=True), strict=True))

    def _due(self, windows: dict[str | None, Window], closed: list[tuple], passed: int) -> Iterator[pd.DataFrame]:
        """All closed windows, with those that no row can reach any more; the others stay, with a timer for the first."""
        closed = closed + [(k, *w) for k, w in windows.items() if w[0] + self.width < passed]
        windows = {k: w for k, w in windows.items() if w[0] + self.width >= passed}
        if windows:
            self.windows.update((list(windows), *map(list, zip(*windows.values(), strict=True))))
            first = min(w[0] for w in windows.values()) + self.width
            self.handle.registerTimer(-((first // self.slot + 1) * self.slot // -1000))
        else:
            self.windows.clear()
        if closed:
            key, *columns = zip(*closed, strict=True)
            names = ("start_us", "last_us", "n", "first_idx")
            yield pd.DataFrame({"key": pd.Series(key, dtype=object), **{c: pd.Series(v, dtype="int64") for c, v in zip(names, columns, strict=True)}})

    def close(self) -> None:
        pass


def burst_stream(
    rows: DataFrame, window_seconds: int, threshold: int, lateness: str = "10 minutes", slot: str = "1 second", groups: int = GROUPS
) -> DataFrame:
    """Closed windows of a stream with ``key``, ``timestamp`` and ``event_idx``; rows without a time are in none.

    Rows first gather by key, ``slot`` and a salt, so a key that holds much of the stream is spread over
    the cluster, also while its rows wait for the watermark; of a slot only its sorted times go on, in
    one row per salt. The windows are kept by ``groups`` of keys. A window is emitted once the watermark has passed the
    slot of its end; rows later than ``lateness`` are dropped by the watermark. The session needs the RocksDB state store.
    """
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    if rows.sparkSession.conf.get(STATE_PROVIDER_KEY, None) != STATE_PROVIDER:
        raise ValueError(f"the stream keeps its state in RocksDB: set {STATE_PROVIDER_KEY} to {STATE_PROVIDER}")
    timed = rows.filter("timestamp IS NOT NULL").withWatermark("timestamp", lateness)
    salted = timed.groupBy("key", F.window("timestamp", slot).alias("slot"), F.pmod(F.xxhash64("event_idx"), F.lit(SALTS)).alias("salt"))
    gathered = salted.agg(F.collect_list(F.struct(F.unix_micros("timestamp").alias("t"), F.col("event_idx").alias("idx"))).alias("_rows"))
    group = F.pmod(F.xxhash64("key"), F.lit(groups)).alias("key_group")
    slots = gathered.select(group, "key", "slot", F.col("_rows.t").alias("times"), F.col("_rows.idx").alias("places"))
    slot_us = rows.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL '{slot}')").first()[0]
    return slots.groupBy("key_group").transformWithStateInPandas(
        statefulProcessor=GreedyWindows(window_seconds * 1_000_000, threshold, slot_us),
        outputStructType=BURST_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )
