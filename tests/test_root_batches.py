"""Debouncing by root on a stream: equal to the table form, in order or not, across a restart."""

import datetime as dt
import random

import pytest

from gramlode import debounce, flush, fresh_folder, read_changes, with_flush
from gramlode.streaming.roots import root_batches

EVENTS = "root string, path string, kind string, ts timestamp"
BASE = dt.datetime(2024, 1, 1)


def rows_of(df):
    return sorted((r.root, r.start, r.path, r.n_events) for r in df.collect())


def steps(seed, shuffled):
    """Events of three roots in files, one a steadily busy one; within a file, and by up to 3 s across files, out of order."""
    r = random.Random(seed)
    events, at = [], {"a": 0.0, "b": 0.0, "busy": 0.0}
    for _ in range(260):
        root = r.choice(list(at))
        at[root] += r.choice([0.05, 0.3, 0.8, 0.8, 0.801, 2.5] if root != "busy" else [0.1, 0.5, 0.8])
        events.append((root, f"/{root}/{r.randint(0, 5)}", r.choice(["create", "modify", "remove", "access"]), BASE + dt.timedelta(seconds=round(at[root], 3))))
    events.sort(key=lambda e: e[3].timestamp() + (r.uniform(0, 3) if shuffled else 0))
    return [events[k : k + 40] for k in range(0, len(events), 40)]


@pytest.mark.parametrize("seed,shuffled", [(1, False), (2, True)])
def test_equals_the_table_form_across_restarts(spark, seed, shuffled):
    landing, marks, out, mark = (fresh_folder(spark, n) for n in ("landing", "marks", "out", "mark"))
    files = steps(seed, shuffled)
    spark.createDataFrame([], EVENTS).write.parquet(marks)
    spark.createDataFrame([], EVENTS).write.parquet(landing)

    def drain():  # each time a new query, which goes on from the checkpoint
        runs = root_batches(with_flush(read_changes(spark, landing), marks), delay="4 seconds")
        sink = runs.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True)
        sink.outputMode("append").start(out).awaitTermination()

    for k, file in enumerate(files):
        spark.createDataFrame(file, EVENTS).coalesce(2).write.mode("append").parquet(landing)
        if k % 2:
            drain()
    early = rows_of(spark.read.parquet(out))
    flush(spark, marks)
    drain()
    got = rows_of(spark.read.parquet(out))
    want = rows_of(debounce(spark.read.schema(EVENTS).parquet(landing)))
    assert got == want and early and set(early) < set(want)
    # a run comes out whole: all its paths, or none
    assert all({e[2] for e in early if e[:2] == run} == {w[2] for w in want if w[:2] == run} for run in {e[:2] for e in early})


def test_exact_gap_and_one_microsecond_more(spark):
    landing, marks, out, mark = (fresh_folder(spark, n) for n in ("landing", "marks", "out", "mark"))
    times = [0, 800_000, 1_600_001, 5_000_000]
    rows = [("r", f"p{k}", "modify", BASE + dt.timedelta(microseconds=t)) for k, t in enumerate(times)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(landing)
    spark.createDataFrame([], EVENTS).write.parquet(marks)
    flush(spark, marks)
    runs = root_batches(with_flush(read_changes(spark, landing), marks), delay="0 seconds")
    sink = runs.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True)
    sink.start(out).awaitTermination()
    starts = {p: round((s - BASE) / dt.timedelta(microseconds=1)) for _, s, p, _ in rows_of(spark.read.parquet(out))}
    assert starts == {"p0": 0, "p1": 0, "p2": 1_600_001, "p3": 5_000_000}
