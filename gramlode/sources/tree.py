"""Reading trees of files inside tasks, with Arrow file systems.

Spark's own file sources leave out every name that starts with ``_`` and gather the listing of all
files on the driver. Here tasks walk the tree level by level, each folder with the ignore rules in
force for it, and stream rows; the driver knows how many folders are left, no more. File contents go
straight from the task that reads them into the plan.

Only what is not found counts as gone. Every other error of the file system fails the task, and the
job with it, so that a folder or file that could not be read is never taken for a deleted one.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.functions.ignore import RULE_FILES, parse_rules

WALK_SCHEMA = "kind string, path string, mtime bigint, size bigint, state string"
CONTENT_BATCH_BYTES = 16 * 1024 * 1024
TASK_BYTES = 128 * 1024 * 1024
FOLDERS_AT_ONCE = 256           # folders a task enters below the ones it was given, before it hands the rest on
ALWAYS = len(RULE_FILES) - 1    # rank of the rules that hold outside repositories too
GLOBAL = -1                     # rank of the rules of a global file, weaker than any other


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a bare path or URI, and the path on it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _children(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    """Entries of a folder without links; none when it is gone."""
    try:
        infos = fs.get_file_info(pafs.FileSelector(folder, recursive=False))
    except FileNotFoundError:
        return []
    local = isinstance(fs, pafs.LocalFileSystem)
    return [i for i in infos if not (local and os.path.islink(i.path))]


def _read_small(fs: pafs.FileSystem, path: str) -> str | None:
    try:
        with fs.open_input_stream(path) as f:
            return f.read().decode("utf-8", "replace")
    except (FileNotFoundError, NotADirectoryError):
        return None


def _millis(info: pafs.FileInfo) -> int:
    return (info.mtime_ns or 0) // 1_000_000


# --------------------------------------------------------------------------- rules of a folder


@functools.lru_cache(maxsize=65536)
def _compiled(regex: str) -> re.Pattern | None:
    try:
        return re.compile(regex, re.S)
    except re.error:
        return None


class Rules:
    """Ignore rules in force in a folder: (rank, directory, position, regex, negated, dir_only)."""

    def __init__(self, rules: list = (), repository: bool = False):
        self.rules, self.repository = list(rules), repository

    def entered(self, folder: str, top: bool, texts: dict[str, str]) -> Rules:
        """Those of a folder below: its rule files come on top, and a repository starts with its own."""
        kept = [r for r in self.rules if r[0] in (ALWAYS, GLOBAL)] if top else self.rules
        inside = self.repository or top
        own = [
            (rank, folder, seq, *rule)
            for rank, name in enumerate(RULE_FILES) if name in texts and (inside or rank == ALWAYS)
            for seq, rule in enumerate(parse_rules(texts[name]))
        ]
        return Rules([*kept, *own], inside)

    def ignored(self, path: str, is_dir: bool) -> bool:
        """The last matching rule of the strongest kind in the nearest directory decides."""
        best = None
        for rank, folder, seq, regex, negated, dir_only in self.rules:
            if dir_only and not is_dir:
                continue
            pattern = _compiled(regex)
            if pattern and pattern.search(path[len(folder.rstrip("/")) + 1 :]):
                best = max(best or (), ((rank, len(folder), seq), negated))
        return best is not None and not best[1]

    def to_json(self) -> str:
        return json.dumps([self.rules, self.repository])

    @classmethod
    def from_json(cls, state: str) -> Rules:
        rules, repository = json.loads(state)
        return cls([tuple(r) for r in rules], repository)


def _own_rules(fs: pafs.FileSystem, folder: str, names: set[str] | None = None) -> tuple[bool, dict[str, str]]:
    """Whether a folder is the top of a repository, and the rule files in it."""
    top = ".git" in names if names is not None else fs.get_file_info(f"{folder}/.git").type == pafs.FileType.Directory
    texts = {}
    for name in RULE_FILES:
        if names is None or name in names or (top and "/" in name):
            text = _read_small(fs, f"{folder}/{name}")
            if text is not None:
                texts[name] = text
    return top, texts


def rules_above(fs: pafs.FileSystem, root: str, excludes: str | None = None) -> Rules:
    """Rules that hold for a root from the folders above it and from a global file of rules."""
    parents, parent = [], os.path.dirname(root)
    while parent and parent != os.path.dirname(parent):
        parents.append(parent)
        parent = os.path.dirname(parent)
    rules = Rules()
    if excludes is not None:
        rules.rules = [(GLOBAL, root, seq, *rule) for seq, rule in enumerate(parse_rules(excludes))]
    for folder in reversed(parents):
        rules = rules.entered(folder, *_own_rules(fs, folder))
    return rules


# --------------------------------------------------------------------------- the walk


def visit(fs: pafs.FileSystem, folder: str, rules: Rules, ignore: bool) -> tuple[list[tuple], list[tuple[str, Rules]]]:
    """One folder: the rows of its files, and the folders below it with their rules. Hidden and ignored ones are left out."""
    infos = _children(fs, folder)
    names = {i.base_name for i in infos}
    here = rules.entered(folder, *_own_rules(fs, folder, names)) if ignore else rules
    rows, below = [], []
    for info in infos:
        if info.base_name.startswith("."):
            continue
        is_dir = info.type == pafs.FileType.Directory
        if ignore and here.ignored(info.path, is_dir):
            continue
        if is_dir:
            below.append((info.path, here))
        elif info.type == pafs.FileType.File:
            rows.append(("file", info.path, _millis(info), info.size, None))
    return rows, below


def walk(spark: SparkSession, root: str, table: str, ignore: bool = True, excludes: str | None = None) -> None:
    """Append (kind, path, mtime, size, state) of the files below a root to a table.

    Each round the tasks take the folders that the last round left, enter some of what lies below,
    and hand on the rest: rows of kind ``folder``, with the rules in force, which the next round deals out anew.
    """
    scheme, (fs, start) = _scheme(root), open_fs(root)
    info = fs.get_file_info(start)
    rules = rules_above(fs, start, excludes) if ignore else Rules()
    if info.type == pafs.FileType.File:
        first = [("file", scheme + start, _millis(info), info.size, None)]
    else:
        first = [("folder", scheme + start, 0, 0, rules.to_json())]
    number = 0
    spark.createDataFrame(first, WALK_SCHEMA).write.parquet(f"{table}/round={number}")
    while True:
        folders = spark.read.schema(WALK_SCHEMA).parquet(f"{table}/round={number}").where("kind = 'folder'")
        left = folders.count()
        if not left:
            return
        number += 1
        tasks = min(left, 4 * spark.sparkContext.defaultParallelism)
        folders.repartition(tasks).mapInArrow(_descend(scheme, ignore), WALK_SCHEMA).write.parquet(f"{table}/round={number}")


def _descend(scheme: str, ignore: bool):
    """A task's part of a round."""
    names = ["kind", "path", "mtime", "size", "state"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list[tuple]) -> pa.RecordBatch:
            out = [(kind, scheme + path, *rest) for kind, path, *rest in out]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            for path, state in zip(batch.column("path").to_pylist(), batch.column("state").to_pylist()):
                fs, at = open_fs(path)
                stack, out, entered = [(at, Rules.from_json(state))], [], 0
                while stack and entered < FOLDERS_AT_ONCE:
                    found, below = visit(fs, *stack.pop(), ignore)
                    stack += below
                    out += found
                    entered += 1
                    if len(out) >= 10_000:
                        yield made(out)
                        out = []
                out += [("folder", folder, 0, 0, rules.to_json()) for folder, rules in stack]
                if out:
                    yield made(out)

    return rows


def visit_rules(excludes: str | None = None):
    """For rows of single files (path, root): keeps those that no rule between file system top and file ignores."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, Rules | None] = {}

            def of(folder: str, root: str) -> Rules | None:
                """Rules in force in a folder; None if it lies in an ignored one."""
                if folder not in known:
                    fs, at = open_fs(folder)
                    if folder == root:
                        rules = rules_above(fs, at, excludes)
                    else:
                        rules = of(os.path.dirname(folder), root)
                        rules = None if rules is None or rules.ignored(at, True) else rules
                    if rules is not None:
                        rules = rules.entered(at, *_own_rules(fs, at))
                    known[folder] = rules
                return known[folder]

            keep = []
            for path, root in zip(batch.column("path").to_pylist(), batch.column("root").to_pylist()):
                rules = of(os.path.dirname(path), root) if path != root else Rules()
                keep.append(rules is not None and not rules.ignored(open_fs(path)[1], False))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return keep


def _scheme(root: str) -> str:
    return root.split("://", 1)[0] + "://" if "://" in root and not root.startswith("file:") else ""


def with_content(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Add ``content`` to rows with a ``path``; files that vanished drop out.

    The rows are spread first: they are small, what they make a task read is not. Where they tell
    ``size``, there are as many tasks as it takes for each to read about ``TASK_BYTES``.
    """
    if tasks is None:
        tasks = 2 * files.sparkSession.sparkContext.defaultParallelism
        if "size" in files.columns:
            tasks = max(tasks, -(-(files.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, contents, held = [], [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    fs, at = open_fs(path)
                    with fs.open_input_stream(at) as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                taken.append(i)
                contents.append(data)
                held += len(data)
                if held >= CONTENT_BATCH_BYTES:
                    yield _extended(batch, taken, contents)
                    taken, contents, held = [], [], 0
            if taken:
                yield _extended(batch, taken, contents)

    return files.repartition(tasks).mapInArrow(read, schema + ", content binary")


def with_status(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """Add present ``mtime`` and ``size`` to rows with a ``path``; only regular files stay."""
    tasks = tasks or 2 * paths.sparkSession.sparkContext.defaultParallelism
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema)

    def stat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, mtimes, sizes = [], [], []
            for i, path in enumerate(batch.column("path").to_pylist()):
                fs, at = open_fs(path)
                info = fs.get_file_info(at)
                if info.type == pafs.FileType.File:
                    taken.append(i)
                    mtimes.append(_millis(info))
                    sizes.append(info.size)
            rows = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(mtimes, pa.int64()), pa.array(sizes, pa.int64())],
                [*batch.schema.names, "mtime", "size"],
            )

    return paths.repartition(tasks).mapInArrow(stat, schema + ", mtime bigint, size bigint")


def _extended(batch: pa.RecordBatch, taken: list[int], contents: list[bytes]) -> pa.RecordBatch:
    rows = batch.take(pa.array(taken, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [*rows.columns, pa.array(contents, pa.binary())], [*batch.schema.names, "content"]
    )
