"""The index: tables of documents, postings and gram counts, kept in segments.

Layout below the index folder::

    docs/seg=S/part=P/          doc, path, root, enc, mtime, size, n_grams, grams[, text]
    postings/seg=S/chunk=C/bucket=B/   gram, block, docs   the documents of a block holding a gram
    gram_counts/seg=S/          gram, n               documents per gram
    paths/seg=S/bucket=B/       path, doc             to find documents by path
    retired/seg=S/              dead_seg, dead_doc, removed
    commits/00000001.json       the live segments; the highest number is the current state

A full build writes one segment, a sync or a micro-batch adds one and retires the documents it
replaces, ``compact`` folds them together. Readers only see what a commit names, so a job that
dies half-way leaves the index as it was.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.constants import (
    BLOCK_BITS,
    BROADCAST_ROWS,
    DOCS_PER_FILE,
    FOLD_RATIO,
    LOOKUP_STEP,
    MAX_BUCKETS,
    PART_BITS,
    PATHS_PER_BUCKET,
    POSTINGS_PER_BUCKET,
    SEGMENT_TASKS,
    SMALL_SPLIT_BYTES,
)
from gramlode.operators.gramlists import posting_lists, with_grams
from gramlode.session import configure, small_batches
from gramlode.sources.folder import Folder

TEXTS_SCHEMA = "path string, root string, enc string, mtime bigint, size bigint, text string"
DOCS_SCHEMA = (
    "doc bigint, path string, root string, enc string, mtime bigint, size bigint, "
    "n_grams int, grams array<string>, part int"
)
POSTINGS_SCHEMA = "gram string, block bigint, docs array<bigint>, chunk int, bucket int"
PATHS_SCHEMA = "path string, doc bigint, bucket int"
RETIRED_SCHEMA = "dead_seg string, dead_doc bigint, removed boolean"
FILE_COLUMNS = ("path", "root", "enc", "mtime", "size", "n_grams")


@dataclass
class Commit:
    """What one version of the index consists of."""

    version: int = 0
    segments: list[dict] = field(default_factory=list)
    retired: int = 0
    retired_by: list[str] = field(default_factory=list)
    has_text: bool = False
    file_count: int = 0
    last_build: str | None = None
    last_sync: str | None = None
    batch: str | None = None
    roots: list[dict] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(self.__dict__, indent=1)


class Index:
    """One committed version of an index; re-open to see later commits."""

    def __init__(self, spark: SparkSession, path: str, commit: Commit):
        self.spark, self.path, self.commit = configure(spark), path, commit

    # ------------------------------------------------------------------ tables

    def _segments(self, table: str) -> list[str]:
        return [f"{self.path}/{table}/seg={s['id']}" for s in self.commit.segments]

    def _read(self, table: str, schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema + ", seg string").option("basePath", f"{self.path}/{table}")
        if not self.commit.segments:
            return self.spark.createDataFrame([], schema + ", seg string")
        return reader.parquet(*self._segments(table))

    def _some(self, table: str, schema: str, below: dict[str, str]) -> DataFrame:
        """Rows of the folders that match a glob below each named segment; no other folder is listed."""
        folder = Folder(self.spark, f"{self.path}/{table}")
        paths = [p for seg, glob in sorted(below.items()) for p in folder.matching(f"seg={seg}/{glob}")]
        if not paths:
            return self.spark.createDataFrame([], schema + ", seg string")
        return self.spark.read.schema(schema + ", seg string").option("basePath", f"{self.path}/{table}").parquet(*paths)

    def retired(self) -> DataFrame:
        """Documents of live segments that a later commit replaced or removed."""
        ids = [s["id"] for s in self.commit.segments]
        tables = [f"{self.path}/retired/seg={s}" for s in self.commit.retired_by]
        reader = self.spark.read.schema(RETIRED_SCHEMA)
        return reader.parquet(*tables).where(F.col("dead_seg").isin(ids))

    def docs(self, *columns: str, live: bool = True) -> DataFrame:
        """Documents with ``seg``, ``doc`` and the asked columns.

        Rows that carry texts are asked for with ``live=False`` and passed to ``live`` when they
        have become small: a long list of retired documents must not make texts move.
        """
        schema = DOCS_SCHEMA + (", text string" if self.commit.has_text else "")
        docs = self._read("docs", schema).select("seg", "doc", *columns)
        return self.live(docs) if live else docs

    def docs_numbered(self, keys: list, *columns: str) -> DataFrame:
        """``docs``, live or not, for a short list of (seg, doc): only pages that hold them are read.

        The numbers are literals, a limited count per scan, so that they reach Parquet.
        """
        wanted: dict[str, list[int]] = {}
        for k in keys:
            wanted.setdefault(k["seg"], []).append(k["doc"])
        schema = DOCS_SCHEMA + (", text string" if self.commit.has_text else "")
        parts = {seg: sorted({n >> (33 + PART_BITS) for n in numbers}) for seg, numbers in wanted.items()}
        docs = self._some("docs", schema, {seg: _named("part", p) for seg, p in parts.items()})
        docs = docs.select("seg", "doc", "part", *columns)
        scans = []
        for seg, numbers in sorted(wanted.items()):
            numbers.sort()
            for i in range(0, len(numbers), LOOKUP_STEP):
                some = numbers[i : i + LOOKUP_STEP]
                parts = sorted({n >> (33 + PART_BITS) for n in some})
                scans.append(
                    docs.where((F.col("seg") == seg) & F.col("part").isin(parts) & F.col("doc").isin(some))
                )
        return reduce(DataFrame.unionByName, scans, docs.where("false") if not scans else scans.pop()).drop("part")

    def live(self, docs: DataFrame) -> DataFrame:
        """Rows of a table with (seg, doc) whose document is live."""
        if not self.commit.retired:
            return docs
        dead = self.retired().select(F.col("dead_seg").alias("seg"), F.col("dead_doc").alias("doc"))
        if self.commit.retired <= BROADCAST_ROWS:
            dead = F.broadcast(dead)
        return docs.join(dead, ["seg", "doc"], "left_anti")

    def live_in_place(self, docs: DataFrame) -> DataFrame:
        """``live`` for rows that carry texts, with ``part``: no text moves, however many documents are retired.

        The retired ones are broadcast a share at a time, each to the document folders it belongs to.
        """
        shares = max(1, -(-self.commit.retired // BROADCAST_ROWS))
        dead = self.retired().select(F.col("dead_seg").alias("seg"), F.col("dead_doc").alias("doc"))
        of = lambda part, i: F.pmod(part, F.lit(shares)) == i
        kept = [
            docs.where(of(F.col("part"), i)).join(F.broadcast(dead.where(of(part_of_doc("doc"), i))), ["seg", "doc"], "left_anti")
            for i in range(shares)
        ]
        return reduce(DataFrame.unionByName, kept)

    def files(self) -> DataFrame:
        """Live files: path, root, enc, mtime, size, n_grams."""
        return self.docs(*FILE_COLUMNS).drop("seg", "doc")

    def postings(self, grams: list[str] | None = None) -> DataFrame:
        """(seg, gram, block, docs) of all or of the given grams, retired documents included.

        A block is a run of at most ``2**BLOCK_BITS`` documents, so ``docs`` is never long.

        For given grams only their bucket folders are listed, by explicit paths, and, the files being
        sorted by gram, only the row groups and pages that hold them are read.
        """
        if grams is None:
            return self._read("postings", POSTINGS_SCHEMA).select("seg", "gram", "block", "docs")
        below, where = {}, F.lit(False)
        for s in self.commit.segments:
            buckets = sorted({bucket_of(g, s["buckets"]) for g in grams})
            below[s["id"]] = "chunk=*/" + _named("bucket", buckets)
            where = where | ((F.col("seg") == s["id"]) & F.col("bucket").isin(buckets))
        rows = self._some("postings", POSTINGS_SCHEMA, below).where(where & F.col("gram").isin(grams))
        return rows.select("seg", "gram", "block", "docs")

    def pairs(self, grams: list[str] | None = None) -> DataFrame:
        """``postings`` with one row per distinct (seg, doc, gram)."""
        return self.postings(grams).select("seg", "gram", F.explode("docs").alias("doc"))

    def located(self, paths: DataFrame, bound: int) -> DataFrame:
        """(seg, doc, and the columns of ``paths``) of the live documents with these paths; a null one is that of all without a path.

        Only the bucket folders that can hold one of the paths are read, so a small batch of
        changes does not scan the list of all files. ``bound`` is an upper bound on the paths.
        """
        by_count: dict[int, list[str]] = {}
        for s in self.commit.segments:
            by_count.setdefault(s["path_buckets"], []).append(s["id"])
        found = []
        for n, ids in sorted(by_count.items()):
            asked = paths.withColumnRenamed("path", "_path").withColumn("_bucket", path_bucket("_path", n))
            buckets = sorted(r["_bucket"] for r in asked.select("_bucket").distinct().collect())
            asked = F.broadcast(asked) if bound <= BROADCAST_ROWS else asked
            rows = self._some("paths", PATHS_SCHEMA, {seg: _named("bucket", buckets) for seg in ids})
            same = (F.col("bucket") == F.col("_bucket")) & F.col("path").eqNullSafe(F.col("_path"))
            found.append(rows.join(asked, same).select("seg", "doc", *paths.columns))
        if not found:
            return self._read("paths", PATHS_SCHEMA).select("seg", "doc", "path").join(paths, "path")
        return self.live(reduce(DataFrame.unionByName, found))

    def gram_counts(self) -> DataFrame:
        """(gram, n): documents per gram. Retired documents still count, so ``n`` is an upper bound."""
        rows = self._read("gram_counts", "gram string, n bigint").select("gram", "n")
        if len(self.commit.segments) < 2:
            return rows
        return rows.groupBy("gram").agg(F.sum("n").alias("n"))

    def count_of(self, grams: list[str]) -> dict[str, int]:
        """Upper bound on the documents holding each of a query's grams, 0 for unknown grams."""
        found = self.gram_counts().where(F.col("gram").isin(grams)).collect() if grams else []
        return {**dict.fromkeys(grams, 0), **{r["gram"]: r["n"] for r in found}}


def _named(column: str, values: list[int]) -> str:
    """Glob of the partition folders with these values."""
    return f"{column}={{{','.join(map(str, values))}}}" if len(values) > 1 else f"{column}={values[0]}" if values else "none"


def bucket_of(gram: str, buckets: int) -> int:
    """The driver's side of ``bucket_col``."""
    return zlib.crc32(gram.encode("utf-8")) % buckets


def bucket_col(gram: Column | str, buckets: int) -> Column:
    gram = F.col(gram) if isinstance(gram, str) else gram
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")


def path_bucket(path: str, buckets: int) -> Column:
    """``bucket_col`` of a path, which may be null."""
    return bucket_col(F.coalesce(path, F.lit("")), buckets)


# --------------------------------------------------------------------------- writing


def new_segment_id() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S") + "-" + uuid.uuid4().hex[:8]


def now_text() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def spread(df: DataFrame) -> DataFrame:
    """Give a source too small to fill the cluster two partitions per core.

    Only such inputs are moved; a large source keeps its own splits and is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if _source_bytes(df) < cores * SMALL_SPLIT_BYTES else df


def _source_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan, without running it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def write_docs(docs: DataFrame, path: str, seg: str) -> None:
    """Write the document table of a segment from rows that already carry ``grams``.

    ``doc`` numbers rows within the segment, rising within each file and with the file, so a lookup
    by number prunes folders by ``part`` and pages by the Parquet page index.
    """
    text = ["text"] if "text" in docs.columns else []
    spark = docs.sparkSession
    # A task's rows all belong to one part: a second open writer spares the sort by part.
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "2")
    try:
        (
            docs.select(
                F.monotonically_increasing_id().alias("doc"),
                "path", "root", "enc", "mtime", "size",
                F.size("grams").alias("n_grams"),
                "grams",
                *text,
            )
            .withColumn("part", part_of_doc("doc"))
            .write.mode("overwrite")
            .option("compression", "zstd")
            .option("maxRecordsPerFile", DOCS_PER_FILE)
            .partitionBy("part")
            .parquet(f"{path}/docs/seg={seg}")
        )
    finally:
        spark.conf.set(setting, before)


def part_of_doc(doc: str) -> Column:
    """Folder of a document: the number of its build task, a few tasks to a folder."""
    return F.shiftright(doc, 33 + PART_BITS).cast("int")


def invert(spark: SparkSession, path: str, seg: str, buckets: int | None = None) -> dict:
    """Turn the document table of a segment into postings and gram counts; describe the segment.

    A chunk covers the documents of at most ``SEGMENT_TASKS`` build tasks, which bounds the shuffle
    of one job however large the build is. Documents are gathered per gram and block: a block lies
    within one task's input, so the lists are made before the shuffle, and no list grows with the
    corpus however common its gram. They are made in Arrow batches and travel as 16 bits a document: no row is made for a pair
    of document and gram, and nothing is sorted by pairs. Buckets of common grams are split by the rebalance.
    """
    small_batches(spark)
    docs = spark.read.schema(DOCS_SCHEMA).parquet(f"{path}/docs/seg={seg}")
    chunk = F.floor(F.shiftright("doc", 33) / SEGMENT_TASKS).cast("int")
    sizes = {
        r["chunk"]: (r["files"], r["postings"])
        for r in docs.groupBy(chunk.alias("chunk"))
        .agg(F.count("*").alias("files"), F.sum(F.col("n_grams").cast("bigint")).alias("postings"))
        .collect()
    }
    files = sum(f for f, _ in sizes.values())
    total = sum(p for _, p in sizes.values())
    largest = max((p for _, p in sizes.values()), default=0)
    if buckets is None:
        buckets = min(MAX_BUCKETS, max(1, -(-largest // POSTINGS_PER_BUCKET)))
    parts_per_chunk = SEGMENT_TASKS >> PART_BITS
    whole = lambda low: F.shiftleft("block", BLOCK_BITS).bitwiseOR(low.cast("bigint").bitwiseAND(F.lit(0xFFFF)))
    for c, (_, postings) in sorted(sizes.items()):
        partitions = max(buckets, min(-(-postings // POSTINGS_PER_BUCKET), 4 * MAX_BUCKETS), 1)
        (
            docs.where(F.col("part").between(c * parts_per_chunk, (c + 1) * parts_per_chunk - 1))
            .select("doc", "grams")
            .mapInArrow(posting_lists(BLOCK_BITS), "gram string, block bigint, docs array<smallint>")
            .groupBy("gram", "block")
            .agg(F.flatten(F.collect_list("docs")).alias("docs"))
            .withColumn("bucket", bucket_col("gram", buckets))
            .hint("rebalance", partitions, "bucket")
            .sortWithinPartitions("bucket", "gram", "block")
            .select("gram", "block", F.sort_array(F.transform("docs", whole)).alias("docs"), "bucket")
            .write.mode("overwrite")
            .option("compression", "zstd")
            .option("parquet.block.size", 32 * 1024 * 1024)
            .partitionBy("bucket")
            .parquet(f"{path}/postings/seg={seg}/chunk={c}")
        )
    if files:
        counts = (
            spark.read.schema(POSTINGS_SCHEMA).parquet(f"{path}/postings/seg={seg}")
            .groupBy("gram").agg(F.sum(F.size("docs")).alias("n"))
        )
        counts.orderBy("gram").write.mode("overwrite").parquet(f"{path}/gram_counts/seg={seg}")
    path_buckets = min(MAX_BUCKETS, max(1, -(-files // PATHS_PER_BUCKET)))
    (
        docs.select("path", "doc")
        .withColumn("bucket", path_bucket("path", path_buckets))
        .hint("rebalance", path_buckets, "bucket")
        .sortWithinPartitions("bucket", "path")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{path}/paths/seg={seg}")
    )
    return {"id": seg, "buckets": buckets, "path_buckets": path_buckets, "files": files, "postings": total}


def write_segment(texts: DataFrame, path: str, seg: str, store_text: bool) -> dict:
    """Gram extraction, document table, postings and counts for new texts.

    The grams of a text are computed once: the postings are made from the written table, which is
    also what a lost executor's tasks read again.
    """
    spark = configure(texts.sparkSession)
    small_batches(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    docs = spread(texts).mapInArrow(with_grams, f"{schema}, grams array<string>")
    write_docs(docs if store_text else docs.drop("text"), path, seg)
    return invert(spark, path, seg)


def commit_next(spark: SparkSession, path: str, base: Commit | None, **changes) -> Index:
    """Publish a new version; fails if another writer published in between."""
    state = {**(base.__dict__ if base else Commit().__dict__), **changes}
    state["version"] = (base.version if base else 0) + 1
    commit = Commit(**state)
    Folder(spark, path).create_text(f"commits/{commit.version:08d}.json", commit.to_json())
    return Index(spark, path, commit)


# --------------------------------------------------------------------------- opening


def current_commit(spark: SparkSession, path: str) -> Commit | None:
    folder = Folder(spark, path)
    names = [n for n in folder.names("commits") if n.endswith(".json")]
    return Commit(**json.loads(folder.read_text(f"commits/{names[-1]}"))) if names else None


def is_built(spark: SparkSession, path: str) -> bool:
    return current_commit(spark, path) is not None


def open_index(spark: SparkSession, path: str) -> Index:
    """The current committed state; ``FileNotFoundError`` when it was never built."""
    commit = current_commit(spark, path)
    if commit is None:
        raise FileNotFoundError(f"no index at {path}: build it first")
    return Index(spark, path, commit)


def build_index(
    texts: DataFrame,
    path: str,
    *,
    force: bool = True,
    store_text: bool = True,
    roots: list[dict] | None = None,
) -> Index:
    """Index all rows of (path, root, enc, mtime, size, text).

    ``force`` starts anew. Without it documents are replaced by path and those of files that are no
    longer there stay, until a ``sync`` drops them. ``store_text`` keeps the text next to the
    document so that verification reads only the pages it needs; without it the corpus is read
    again at search time.
    """
    spark = configure(texts.sparkSession)
    base = current_commit(spark, path)
    if base is not None and not force:
        store_text = base.has_text
    seg = new_segment_id()
    segment = write_segment(texts, path, seg, store_text)
    kept, retired, retired_by = [], 0, []
    if base is not None and not force:
        kept, retired_by = base.segments, [*base.retired_by, seg]
        retired = base.retired + retire(
            Index(spark, path, base), seg, _new_paths(spark, path, seg), segment["files"]
        )
    return commit_next(
        spark, path, base,
        segments=[s for s in [*kept, segment] if s["files"]],
        retired=retired,
        retired_by=retired_by,
        has_text=store_text,
        file_count=sum(s["files"] for s in [*kept, segment]) - retired,
        last_build=now_text(),
        roots=roots or (base.roots if base else []),
        batch=None,
    )


def _new_paths(spark: SparkSession, path: str, seg: str) -> DataFrame:
    """(path, removed=false) of the documents a segment brings."""
    docs = spark.read.schema(DOCS_SCHEMA).parquet(f"{path}/docs/seg={seg}")
    return docs.select("path", F.lit(False).alias("removed"))


def retire(index: Index, seg: str, gone: DataFrame, bound: int) -> int:
    """Record the live documents whose ``path`` is in (path, removed); returns how many.

    ``bound`` is an upper bound on the rows of ``gone``.
    """
    target = f"{index.path}/retired/seg={seg}"
    once = gone.groupBy("path").agg(F.min("removed").alias("removed"))
    (
        index.located(once, bound)
        .select(F.col("seg").alias("dead_seg"), F.col("doc").alias("dead_doc"), "removed")
        .write.mode("overwrite")
        .parquet(target)
    )
    return index.spark.read.parquet(target).count()


def compact(index: Index, only: list[str] | None = None) -> Index:
    """Fold all segments, or those named, into one without their retired documents; no text is read for grams."""
    columns = [*FILE_COLUMNS, "grams"] + (["text"] if index.commit.has_text else [])
    seg, commit = new_segment_id(), index.commit
    chosen = [s for s in commit.segments if only is None or s["id"] in only]
    rest = [s for s in commit.segments if s not in chosen]
    part = Index(index.spark, index.path, replace(commit, segments=chosen))
    docs = part.docs("part", *columns, live=False)
    write_docs(part.live_in_place(docs) if commit.retired else docs, index.path, seg)
    segment = invert(index.spark, index.path, seg)
    segments = [*rest, *([segment] if segment["files"] else [])]
    retired = sum(s["files"] for s in segments) - commit.file_count
    return commit_next(
        index.spark, index.path, commit,
        segments=segments, retired=retired, retired_by=commit.retired_by if retired else [],
    )


def foldable(segments: list[dict], most: int) -> list[str]:
    """Which segments to fold when there are more than ``most``: small neighbours in size, not a large one for their sake."""
    chosen, total = [], 0
    for s in sorted(segments, key=lambda s: s["files"]):
        few = len(segments) - len(chosen) + 1 <= most
        if few and s["files"] > FOLD_RATIO * total and chosen:
            break
        chosen.append(s["id"])
        total += s["files"]
    return chosen if len(segments) > most and len(chosen) > 1 else []


def vacuum(index: Index) -> list[str]:
    """Delete what the given, current version does not use; returns the names.

    Not for while another job still reads or writes an older version.
    """
    folder, commit = Folder(index.spark, index.path), index.commit
    newest = current_commit(index.spark, index.path)
    if newest is None or newest.version != commit.version:
        raise ValueError("only the current version can be vacuumed")
    live = {f"seg={s['id']}" for s in commit.segments}
    used = {t: live for t in ("docs", "postings", "gram_counts", "paths")}
    used["retired"] = {f"seg={s}" for s in commit.retired_by}
    used["work"] = set()
    stale = [f"{t}/{n}" for t, keep in used.items() for n in folder.names(t) if n not in keep]
    stale += [f"commits/{n}" for n in folder.names("commits") if n != f"{commit.version:08d}.json"]
    for name in stale:
        folder.remove(name)
    return stale
