"""Batches of changes on a stream, by root: the distinct paths of a run of events come out together once the root is quiet.

The state of a root is its open runs (where each starts and last changed) and a map from (run, path) to events: a row for
each distinct path that changed since the root was last quiet, however often it did. A root that never is quiet holds at most
a row for each of its files. A timer in event time is set for the moment when the earliest run can no longer grow.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gramlode.constants import DEBOUNCE
from gramlode.streaming.changes import relevant

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTS = "root string, first bigint, last bigint, path string, n bigint"


def micros(gap: str) -> int:
    return round(pd.Timedelta(gap).total_seconds() * 1_000_000)


def partial_runs(events: DataFrame, gap: int) -> DataFrame:
    """(root, first, last, path, n, at): the events of each task folded to a row per root, run and path, before they are shuffled.

    A run within a task is part of one run of the stream, whatever the other tasks hold. Times are microseconds; ``at`` is ``last``.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a batch is bounded, and so is what it is folded in
            runs: dict[tuple, list] = {}
            last: dict[str | None, list] = {}
            columns = (batch.column(c).to_pylist() for c in ("root", "us", "path"))
            for root, us, path in sorted(zip(*columns, strict=True), key=lambda e: e[1]):
                run = last.get(root)
                if run is None or us > run[1] + gap:
                    run = last[root] = [us, us, Counter()]
                    runs[root, us] = run
                run[1] = us
                run[2][path] += 1
            rows = [(root, first, end, path, n) for (root, _), (first, end, paths) in runs.items() for path, n in paths.items()]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["root", "first", "last", "path", "n"])

    folded = events.select("root", "path", F.unix_micros("ts").alias("us")).mapInArrow(fold, _PARTS)
    return folded.withColumn("at", F.timestamp_micros("last"))


class RootRuns(StatefulProcessor):
    """Runs of one root: joined where they touch, given out when the watermark has passed them."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "first bigint", "last bigint")
        self.paths = handle.getMapState("paths", "first bigint, path string", "n bigint")

    def _open(self) -> list[tuple[int, int]]:
        return sorted((k[0], v[0]) for k, v in self.runs.iterator())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self._open()
        spans, counts = [], {}
        for r in rows:  # one row for each path of a task's run
            spans.append((r.first, r.last))
            counts[r.first, r.path] = counts.get((r.first, r.path), 0) + r.n
        joined: list[list[int]] = []
        for first, last in sorted({*before, *spans}):
            if joined and first <= joined[-1][1] + self.gap:
                joined[-1][1] = max(joined[-1][1], last)
            else:
                joined.append([first, last])
        home, k = {}, 0
        for first in sorted({f for f, _ in [*before, *spans]}):
            while k + 1 < len(joined) and joined[k + 1][0] <= first:
                k += 1
            home[first] = joined[k][0]
        moved = {first for first, _ in before if home[first] != first}
        if moved:  # a run began earlier than was known, or two became one
            for old, n in list(self.paths.iterator()):
                if old[0] in moved:
                    counts[old[0], old[1]] = counts.get((old[0], old[1]), 0) + n[0]
                    self.paths.removeKey((old[0], old[1]))
            for first in moved:
                self.runs.removeKey((first,))
        total: dict[tuple[int, str], int] = {}
        for (first, path), n in counts.items():
            total[home[first], path] = total.get((home[first], path), 0) + n
        for place, n in total.items():
            held = self.paths.getValue(place)[0] if self.paths.containsKey(place) else 0
            self.paths.updateValue(place, (held + n,))
        known = dict(before)
        for first, last in joined:
            if first in moved or known.get(first) != last:
                self.runs.updateValue((first,), (last,))
        self._wake(joined)
        return iter(())

    def _wake(self, runs) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if runs:
            self.handle.registerTimer(min(last for _, last in runs) // 1000 + self.gap // 1000 + 2)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        runs = self._open()
        done = {first for first, last in runs if last + self.gap <= now}
        for place, n in list(self.paths.iterator()):
            if place[0] in done:
                yield Row(root=key[0], first=place[0], path=place[1], n_events=n[0])
                self.paths.removeKey((place[0], place[1]))
        for first in done:
            self.runs.removeKey((first,))
        self._wake([r for r in runs if r[0] not in done])

    def close(self) -> None:
        pass


def root_batches(events: DataFrame, gap: str = DEBOUNCE, delay: str = "10 seconds") -> DataFrame:
    """(root, start, path, n_events): ``debounce`` for streams. The paths of a run come out together, in one batch, when the
    root has had no event for ``gap``, as soon as the watermark, ``delay`` behind the latest event, tells so.

    Events may come in any order within ``delay``. The stream needs Spark's RocksDB state store, which is set for the session.
    At the end of a change log ``flush`` gives the open runs out.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    parts = partial_runs(relevant(events), micros(gap)).withWatermark("at", delay)
    runs = parts.groupBy("root").transformWithState(
        RootRuns(micros(gap)), "root string, first bigint, path string, n_events bigint", "Append", "EventTime"
    )
    return runs.select("root", F.timestamp_micros("first").alias("start"), "path", "n_events")
