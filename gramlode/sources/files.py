"""Corpora that are trees of files, one encoding per root."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.constants import BINARY_SNIFF_BYTES, BROADCAST_BYTES, MAX_FILE_BYTES, UTF8
from gramlode.functions.encodings import canonical_encoding_str, decode_text, is_binary
from gramlode.functions.ignore import RULE_FILES
from gramlode.functions.paths import ancestors, rel_path
from gramlode.session import configure, fresh_folder
from gramlode.sources.folder import Folder
from gramlode.sources.tables import Verify
from gramlode.sources.tree import WALK_SCHEMA, Rules, open_fs, visit_rules, walk, with_content, with_status



class FileCorpus:
    """All files below a list of (root, encoding) pairs.

    The first use takes a snapshot of the listing, kept as a table in the shared folder; ``refresh``
    takes a new one. Contents are always read as they are. Where roots overlap the last root that
    covers a file gives its encoding.
    """

    def __init__(
        self,
        spark: SparkSession,
        roots: list[tuple[str, str]],
        *,
        max_bytes: int | None = MAX_FILE_BYTES,
        ignore: bool = True,
        excludes: str | None = None,
        sniff: int | None = BINARY_SNIFF_BYTES,
        tasks: int | None = None,
    ):
        """``excludes`` is the path of a global file of ignore rules, the weakest of all."""
        self.spark = configure(spark)
        self.roots = [(_normal(p), canonical_encoding_str(e)) for p, e in roots]
        self.max_bytes, self.ignore, self.sniff, self.tasks = max_bytes, ignore, sniff, tasks
        self.excludes = _global_rules(excludes) if excludes else None
        self._table: str | None = None

    # ------------------------------------------------------------------ listing

    def refresh(self) -> FileCorpus:
        """Take a new snapshot of the listing; the one before is deleted."""
        before, self._table = self._table, fresh_folder(self.spark, "walk")
        for seq, (root, _) in enumerate(self.roots):
            walk(self.spark, root, f"{self._table}/seq={seq}", self.ignore, self.excludes)
        if before:
            Folder(self.spark, before).remove("")
        return self

    def _walked(self) -> DataFrame:
        if self._table is None:
            self.refresh()
        schema = WALK_SCHEMA + ", seq int, round int"
        if not self.roots:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._table)

    def _owned(self, rows: DataFrame) -> DataFrame:
        """Add the root and encoding of each path; a path under no root drops out.

        The roots are a short list of settings, so the choice is an expression, not a join.
        """
        root = enc = None
        for path, name in reversed(self.roots):
            inside = F.startswith("path", F.lit(path.rstrip("/") + "/")) | (F.col("path") == path)
            root = F.when(inside, path) if root is None else root.when(inside, path)
            enc = F.when(inside, name) if enc is None else enc.when(inside, name)
        if root is None:
            return rows.withColumn("root", F.lit("")).withColumn("enc", F.lit(UTF8)).where("false")
        return rows.withColumn("root", root).withColumn("enc", enc).where(F.col("root").isNotNull())

    def listing(self) -> DataFrame:
        """(path, root, enc, mtime, size) of every visible file that no rule ignores, whatever its size."""
        found = self._walked().where(F.col("kind") == "file")
        owned = self._owned(found)
        last = {path: seq for seq, (path, _) in enumerate(self.roots)}
        mine = [(F.col("root") == path) & (F.col("seq") == seq) for path, seq in last.items()]
        if not mine:
            return owned.select("path", "root", "enc", "mtime", "size")
        keep = mine[0]
        for condition in mine[1:]:
            keep = keep | condition
        return owned.where(keep).select("path", "root", "enc", "mtime", "size")

    def indexable(self, listing: DataFrame) -> DataFrame:
        """Listed files that may be indexed, as far as their size tells."""
        return listing if self.max_bytes is None else listing.where(F.col("size") <= self.max_bytes)

    # ------------------------------------------------------------------ texts

    def _decoded(self, rows: DataFrame) -> DataFrame:
        return (
            with_content(rows, self.tasks)
            .where(~is_binary("content", self.sniff))
            .withColumn("text", decode_text("content", "enc"))
            .drop("content")
        )

    def texts(self, keys: DataFrame | None = None, bound: int | None = None) -> DataFrame:
        """(path, root, enc, mtime, size, text) of all indexable files or of the paths in ``keys``."""
        listed = self.indexable(self.listing())
        if keys is not None:
            listed = listed.join(keys.select("path"), "path", "left_semi")
        return self._decoded(listed.select("path", "root", "enc", "mtime", "size"))

    def texts_now(self, paths: DataFrame, bound: int | None = None) -> DataFrame:
        """``texts`` of the given paths by their present state, without a listing of the tree."""
        here = with_status(self._owned(paths.select("path").distinct()), self.tasks)
        here = drop_hidden(here)
        if self.ignore:
            here = here.mapInArrow(visit_rules(self.excludes), here.schema)
        return self._decoded(self.indexable(here).select("path", "root", "enc", "mtime", "size"))

    def missing(self, paths: DataFrame) -> DataFrame:
        """Those of the paths where there is no file."""
        there = with_status(paths.select("path"), self.tasks).select("path")
        return paths.join(there, "path", "left_anti")

    def covers(self, paths: DataFrame) -> DataFrame:
        """The paths that lie under a root."""
        return self._owned(paths).drop("root", "enc")

    def reread(self, found: DataFrame, bound: int | None, verify: Verify) -> DataFrame:
        """``verify``'s hits in the candidate files as they are now, with their n_grams; nothing else is opened."""
        files = with_content(found.select("path", "enc", "n_grams", "size"), self.tasks)
        return verify(files.select("path", "n_grams", decode_text("content", "enc").alias("text")))


def scan_corpus(spark: SparkSession, roots: list[tuple[str, str]], **options) -> FileCorpus:
    """The files below each (path, encoding) root."""
    return FileCorpus(spark, roots, **options)


def _normal(path: str) -> str:
    """Absolute path without links for local roots; other file systems keep their URI."""
    path = path.removeprefix("file://")
    return path.rstrip("/") if "://" in path else os.path.realpath(path)


def _global_rules(path: str) -> str:
    fs, at = open_fs(path)
    with fs.open_input_stream(at) as f:
        return f.read().decode("utf-8", "replace")


def apply_ignore(files: DataFrame, rules: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    """Drop rows of a table whose path ignore rules exclude, themselves or through a directory above.

    ``rules`` has (dir, rank, seq, regex, negated, dir_only), as ``functions.ignore`` makes them. Per entry the last matching rule of the
    strongest kind in the nearest directory decides. With ``repositories`` the rules of a
    repository end where a nested one begins. The rules of a directory are one row, which all paths below it
    share: that row is broadcast while all rules are small, so that no task gathers a directory's paths.
    """
    by_dir = rules.groupBy("dir").agg(
        F.collect_list(F.struct("rank", "dir", "seq", "regex", "negated", "dir_only")).alias("own"), F.lit(False).alias("top")
    )
    if repositories is not None:
        tops = repositories.select(F.col("top").alias("dir"), F.lit(True).alias("is_top")).distinct()
        by_dir = by_dir.join(tops, "dir", "full").select("dir", F.coalesce("own", F.array()).alias("own"), F.coalesce("is_top", F.lit(False)).alias("top"))
    size = rules.agg(F.sum(F.length("regex") + F.length("dir") + 32)).first()[0] or 0
    met = files.select("path").distinct().select("path", F.explode(ancestors("path")).alias("dir"))
    met = met.join(F.broadcast(by_dir) if size <= BROADCAST_BYTES else by_dir, "dir")
    ruled = met.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(F.length("dir").alias("n"), "dir", "top", "own"))).alias("above"))
    ignored = ruled.mapInArrow(_ignored, "path string")
    return files.join(ignored, "path", "left_anti")


def _ignored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths that the rules of the directories above them exclude."""
    for batch in batches:
        out = []
        for path, above in zip(batch.column("path").to_pylist(), batch.column("above").to_pylist()):
            held, known = [], {a["dir"]: a for a in above}
            folders = [path[:k] for k, c in enumerate(path) if c == "/"]
            for folder, entry in zip(folders, [*folders[1:], path]):
                if folder in known:
                    if known[folder]["top"]:
                        held = [r for r in held if r[0] == len(RULE_FILES) - 1]
                    held = held + [tuple(r.values()) for r in known[folder]["own"]]
                if Rules(held).ignored(entry, entry != path):
                    out.append(path)
                    break
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["path"])


def drop_hidden(files: DataFrame) -> DataFrame:
    """Drop files with a component that starts with a dot below their root."""
    return files.where(~rel_path("path", F.col("root")).rlike(r"(^|/)\."))


# --------------------------------------------------------------------------- roots


def read_roots(spark: SparkSession, settings: str, strict: bool = True) -> DataFrame:
    """(path, encoding, seq) from a settings file ``{"roots": [{"path":.., "encoding":..}]}``.

    Without roots this raises, or with ``strict=False`` gives the one root ``.`` in UTF-8.
    """
    from gramlode.functions.encodings import canonical_encoding

    schema = "roots array<struct<path string, encoding string>>"
    parent, _, name = settings.rpartition("/")
    if Folder(spark, parent or ".").exists(name):
        found = spark.read.schema(schema).json(settings, multiLine=True).select(F.posexplode("roots"))
        roots = found.select(
            F.col("col.path").alias("path"),
            canonical_encoding(F.coalesce("col.encoding", F.lit(UTF8))).alias("encoding"),
            F.col("pos").cast("int").alias("seq"),
        )
        if not roots.isEmpty():
            return roots
    if strict:
        raise ValueError(f"no roots configured in {settings}")
    return spark.createDataFrame([(".", UTF8, 0)], "path string, encoding string, seq int")


def resolve_roots(roots: DataFrame, base: str) -> list[tuple[str, str]]:
    """The settings as (absolute path, encoding); relative roots are below ``base``."""
    rows = sorted(roots.collect(), key=lambda r: r["seq"])
    return [(p if "://" in p else _normal(os.path.join(base, p)), e) for p, e, _ in rows]


def parse_root_specs(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """``path@encoding`` texts as (path, encoding)."""
    from gramlode.functions.paths import root_spec_encoding, root_spec_path

    return specs.select(root_spec_path(spec).alias("path"), root_spec_encoding(spec).alias("encoding"))


def assign_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Give each file of a table the root and encoding of the last root that covers it.

    Every directory above a file is looked up among the roots by equality, so whole components are
    compared and no pair of file and root is tried in vain. Files under no root drop out.
    """
    above = files.select("path", F.explode(ancestors("path")).alias("root"))
    found = above.join(roots.select(F.col("path").alias("root"), "encoding", "seq"), "root")
    best = found.groupBy("path").agg(
        F.max_by("root", "seq").alias("root"), F.max_by("encoding", "seq").alias("enc")
    )
    return files.join(best, "path")
