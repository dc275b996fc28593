"""Following a stream of change events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from gramlode.constants import CHANGE_KINDS, DEBOUNCE, RETIRED_SHARE
from gramlode.operators.index import compact, foldable, open_index
from gramlode.operators.sync import apply_changes

EVENTS_SCHEMA = "root string, path string, kind string, ts timestamp"


def read_changes(spark: SparkSession, folder: str, fmt: str = "parquet", **options) -> DataFrame:
    """A stream of change events from files that land in a folder."""
    return spark.readStream.schema(EVENTS_SCHEMA).options(**options).format(fmt).load(folder)


def relevant(events: DataFrame) -> DataFrame:
    """Only events that may change a file: create, modify, remove."""
    return events.where(F.col("kind").isin(*CHANGE_KINDS))


def debounce(events: DataFrame, gap: str = DEBOUNCE, slot: str = "1 hour") -> DataFrame:
    """(root, start, path, n_events): the distinct paths of each run of events without a longer pause.

    For tables. A run belongs to a root; it ends where no event follows within ``gap`` (an event
    exactly ``gap`` later still belongs). Events are ordered within slots of time only, and what a
    slot needs to know of earlier ones, the last event and the last start of a run, comes from one
    summary row per slot; so even a root with most of the events is worked on in parallel.
    """
    kept = relevant(events).select("root", "path", "ts", F.window("ts", slot)["start"].alias("slot"))
    inside = Window.partitionBy("root", "slot").orderBy("ts")
    kept = kept.withColumn("before", F.lag("ts").over(inside))

    slots = kept.groupBy("root", "slot").agg(
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        F.max(F.when(_pause("before", "ts", gap), F.col("ts"))).alias("restart"),
    )
    along = Window.partitionBy("root").orderBy("slot")
    slots = slots.withColumn("previous", F.lag("last").over(along))
    opens = F.col("previous").isNull() | _pause("previous", "first", gap)
    slots = slots.withColumn("opening", F.when(opens, F.col("first")))
    latest = F.coalesce("restart", "opening")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("carried", F.last(latest, ignorenulls=True).over(earlier))

    known = slots.select("root", "slot", F.coalesce("opening", "carried").alias("running"))
    start = F.when(_pause("before", "ts", gap), F.col("ts"))
    runs = kept.withColumn("start", F.last(start, ignorenulls=True).over(inside)).join(known, ["root", "slot"])
    return runs.groupBy("root", F.coalesce("start", "running").alias("start"), "path").agg(
        F.count("*").alias("n_events")
    )


def _pause(before: str, after: str, gap: str) -> Column:
    return F.col(after) > F.col(before) + F.expr(f"interval {gap}")


def debounce_stream(events: DataFrame, gap: str = DEBOUNCE, delay: str = "10 seconds") -> DataFrame:
    """(root, path, start, end, n_events): changes of a path that went quiet for ``gap``.

    For streams. Each path has its own session, so state and output are one row per path and a
    steadily busy root holds nothing back; a path that changed many times comes out once.
    """
    return (
        relevant(events)
        .withWatermark("ts", delay)
        .groupBy("root", "path", F.session_window("ts", gap).alias("run"))
        .agg(F.count("*").alias("n_events"))
        .select("root", "path", F.col("run.start").alias("start"), F.col("run.end").alias("end"), "n_events")
    )


def with_flush(events: DataFrame, folder: str) -> DataFrame:
    """``events`` and what ``flush`` writes to a folder."""
    return events.unionByName(read_changes(events.sparkSession, folder))


def flush(spark: SparkSession, folder: str, at: str = "9999-01-01 00:00:00") -> None:
    """Tell a stream made ``with_flush`` that time has passed: every session that is still open comes out.

    For the end of a change log. The mark is an event of no path, whose own session stays open.
    """
    mark = spark.createDataFrame([(None, None, CHANGE_KINDS[0], at)], "root string, path string, kind string, ts string")
    mark.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def quiet_paths(events: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """(path, n_events) of each path that has had no event for ``gap``, by the clock.

    For streams that are followed as they grow: a path that is saved ten times in a row comes out once, and the last
    one does not wait for a later event.
    """
    millis = int(pd.Timedelta(gap).total_seconds() * 1000)

    def run(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "n_events": [before]})
        else:
            state.update((before + sum(len(p) for p in pages),))
            state.setTimeoutDuration(millis)

    schema = "path string, n_events bigint"
    return relevant(events).groupBy("path").applyInPandasWithState(run, schema, "n bigint", "append", "ProcessingTimeTimeout")


def follow(
    events: DataFrame,
    index_path: str,
    corpus,
    checkpoint: str,
    *,
    gap: str = DEBOUNCE,
    trigger: dict | None = None,
    compact_after: int = 50,
) -> StreamingQuery:
    """Apply a stream of change events to an index, one commit per micro-batch.

    Paths are applied when they have been quiet for ``gap``, so many saves in a row are indexed once. A stream that runs to its end
    (``availableNow`` or ``once``) has no later; there each batch applies its distinct paths. What the present files
    hold decides. The batch number goes into the commit, so a batch replayed after a failure is not applied twice. Once the
    index has more than ``compact_after`` segments the small ones are folded into one; all are when many documents are retired.
    """
    name = checkpoint.rstrip("/").rsplit("/", 1)[-1]
    trigger = trigger or {"processingTime": DEBOUNCE}
    to_the_end = "availableNow" in trigger or "once" in trigger

    def apply(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        index = open_index(spark, index_path)
        index, _ = apply_changes(index, batch.select("path").distinct(), corpus, f"{name}-{number}")
        if index.commit.retired > RETIRED_SHARE * max(1, index.commit.file_count) and len(index.commit.segments) > compact_after // 2:
            compact(index)
        elif small := foldable(index.commit.segments, compact_after):
            compact(index, small)

    return (
        (relevant(events) if to_the_end else quiet_paths(events, gap))
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
