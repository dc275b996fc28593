"""Keeping an index current: snapshot diffs, change batches, and the upsert behind both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.operators.index import (
    DOCS_SCHEMA,
    Index,
    commit_next,
    new_segment_id,
    now_text,
    retire,
    write_segment,
)

# --------------------------------------------------------------------------- diff of two listings


def is_current(mtime: Column | str, indexed: Column | str, size: Column | str, max_bytes: int | None) -> Column:
    """An indexed file is current when its time is exactly the indexed one and it is not too large."""
    mtime, indexed, size = (F.col(c) if isinstance(c, str) else c for c in (mtime, indexed, size))
    same = mtime.eqNullSafe(indexed)
    return same if max_bytes is None else same & (size <= max_bytes)


def changed_files(listing: DataFrame, files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Listed files that are new, or whose time differs from the indexed one."""
    indexed = files.select("path", F.col("mtime").alias("_indexed"), F.lit(True).alias("_known"))
    met = listing.join(indexed, "path", "left")
    stale = F.col("_known").isNull() | ~is_current("mtime", "_indexed", "size", max_bytes)
    return met.where(stale).drop("_indexed", "_known")


def deleted_files(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed paths that are not listed any more."""
    return files.select("path").join(listing.select("path"), "path", "left_anti")


def sync_diff(listing: DataFrame, files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(path, action) with action ``update`` or ``remove``, from one join of the two sides."""
    there = listing.select("path", "mtime", "size", F.lit(True).alias("_there"))
    known = files.select("path", F.col("mtime").alias("_indexed"), F.lit(True).alias("_known"))
    met = there.join(known, "path", "full_outer")
    current = F.col("_known") & is_current("mtime", "_indexed", "size", max_bytes)
    action = F.when(F.col("_there").isNull(), "remove").when(
        ~F.coalesce(current, F.lit(False)), "update"
    )
    return met.select("path", action.alias("action")).where(F.col("action").isNotNull())


def sync_stats(diff: DataFrame) -> DataFrame:
    """One row (updated, removed) of a diff."""
    return diff.agg(
        F.count_if(F.col("action") == "update").alias("updated"),
        F.count_if(F.col("action") == "remove").alias("removed"),
    )


def upsert(current: DataFrame, new: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of ``current`` without the deleted and the replaced paths, plus the new rows."""
    gone = deleted.select("path").unionByName(new.select("path"))
    return current.join(gone, "path", "left_anti").unionByName(new)


# --------------------------------------------------------------------------- applying to an index


@dataclass(frozen=True)
class SyncStats:
    updated: int
    removed: int


def sync(index: Index, corpus, *, compat: bool = False) -> tuple[Index, SyncStats]:
    """Bring the index up to date with a corpus: new and changed files in, vanished ones out.

    Files are compared by metadata alone; only changed ones are read. A file that became too large,
    binary or ignored, or whose root is gone, leaves the index; with ``compat`` it stays as it was
    for as long as it exists. Documents without a path cannot be compared: they are always those listed now.
    """
    if hasattr(corpus, "refresh"):
        corpus.refresh()
    listing = corpus.listing()
    indexable = corpus.indexable(listing)
    files = index.docs("path", "mtime")
    lost = deleted_files(listing if compat else indexable, files)
    if compat and hasattr(corpus, "missing"):
        lost = corpus.missing(lost)  # the listing leaves ignored files out; here they stay while they exist
    stale = changed_files(indexable, files).select("path", F.lit("update").alias("action"))
    work = _Work(index, stale.unionByName(lost.select("path", F.lit("remove").alias("action"))))

    def gone(new: DataFrame) -> DataFrame:
        lost = work.rows("remove").select("path", F.lit(True).alias("removed"))
        if compat:
            return _replaced(new).unionByName(lost)
        # Changed, but no new document came of it.
        dropped = work.rows("update").join(new.select("path"), "path", "left_anti")
        return _replaced(new).unionByName(lost).unionByName(dropped.select("path", F.lit(True).alias("removed")))

    texts = corpus.texts(work.rows("update"), work.count("update"))
    return _apply(index, work, texts, gone, last_sync=now_text())


def apply_changes(index: Index, paths: DataFrame, corpus, batch: str | None = None) -> tuple[Index, SyncStats]:
    """Apply a batch of changed paths: the present file decides, whatever the events said.

    Paths under no root are left alone. A file that is there and passes the filters is indexed
    anew, otherwise its document goes. ``batch`` names the batch; one that the index has already
    taken is not applied again.
    """
    if batch is not None and index.commit.batch == batch:
        return index, SyncStats(0, 0)
    covered = corpus.covers(paths.select("path").distinct())
    work = _Work(index, covered.select("path", F.lit("update").alias("action")))

    def gone(new: DataFrame) -> DataFrame:
        fresh = new.select(F.col("path").alias("_path"), F.lit(True).alias("_new"))
        marked = work.rows("update").join(fresh, F.col("path").eqNullSafe(F.col("_path")), "left")
        return marked.select("path", F.col("_new").isNull().alias("removed"))

    texts = corpus.texts_now(work.rows("update"), work.count("update"))
    return _apply(index, work, texts, gone, batch=batch, last_sync=now_text())


class _Work:
    """The paths a pass has to look at, as a table beside the index.

    Written once, so the listings are compared once, and counted, so that what is joined with texts
    or documents is broadcast only when it is known to be short.
    """

    def __init__(self, index: Index, todo: DataFrame):
        self.spark, self.seg = index.spark, new_segment_id()
        self.path = f"{index.path}/work/seg={self.seg}"
        todo.write.parquet(self.path)
        counted = self._table().groupBy("action").count().collect()
        self.counts = {r["action"]: r["count"] for r in counted}

    def _table(self) -> DataFrame:
        return self.spark.read.schema("path string, action string").parquet(self.path)

    def rows(self, action: str) -> DataFrame:
        return self._table().where(F.col("action") == action).select("path")

    def count(self, action: str) -> int:
        return self.counts.get(action, 0)


def _replaced(new: DataFrame) -> DataFrame:
    return new.select("path", F.lit(False).alias("removed"))


def _apply(index: Index, work: _Work, texts: DataFrame, gone, **changes) -> tuple[Index, SyncStats]:
    """Write new texts as a segment, retire what they replace and what is lost, commit once."""
    spark, seg = index.spark, work.seg
    if not work.counts:
        return commit_next(spark, index.path, index.commit, **changes), SyncStats(0, 0)
    segment = write_segment(texts, index.path, seg, index.commit.has_text)
    new = spark.read.schema(DOCS_SCHEMA).parquet(f"{index.path}/docs/seg={seg}")
    retired = retire(index, seg, gone(new), sum(work.counts.values()))
    removed = spark.read.parquet(f"{index.path}/retired/seg={seg}").where("removed").count() if retired else 0
    stats = SyncStats(segment["files"], removed)
    return commit_next(
        spark, index.path, index.commit,
        segments=[*index.commit.segments, *([segment] if segment["files"] else [])],
        retired=index.commit.retired + retired,
        retired_by=[*index.commit.retired_by, *([seg] if retired else [])],
        file_count=index.commit.file_count + segment["files"] - retired,
        **changes,
    ), stats
