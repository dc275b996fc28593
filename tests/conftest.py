import os
import time

import pytest

from gramlode import FileCorpus, build_index, fresh_folder, local_session, search


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "gramlode-tests", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session
    session.stop()


class Tree:
    """A small tree of files, its index, and searches in it."""

    def __init__(self, spark, folder, roots=None, store_text=True, **options):
        self.spark, self.folder, self.store_text = spark, folder, store_text
        self.roots = roots or {"": "utf-8"}
        self.options = options
        self.index = None

    def write(self, name, data, mtime=None):
        path = self.folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))
        if mtime is not None:
            os.utime(path, (mtime, mtime))
        return path

    def corpus(self):
        roots = [(str(self.folder / r), e) for r, e in self.roots.items()]
        return FileCorpus(self.spark, roots, tasks=2, **self.options)

    def build(self):
        self.where = fresh_folder(self.spark, "test")
        self.index = build_index(self.corpus().texts(), self.where, store_text=self.store_text)
        return self

    def hits(self, query, **kw):
        """(file name, line, text) of the hits, in order."""
        corpus = None if self.store_text else self.corpus()
        found = search(self.index, query, corpus=corpus, **kw).hits.collect()
        return [(os.path.relpath(h.file, os.path.realpath(self.folder)), h.line, h.text) for h in found]

    def lines(self, query, **kw):
        return [(f, n) for f, n, _ in self.hits(query, **kw)]


@pytest.fixture
def tree(spark, tmp_path):
    def make(roots=None, **options):
        return Tree(spark, tmp_path, roots, **options)

    return make


@pytest.fixture
def later():
    """A modification time that no earlier write in the test can have."""
    ticks = iter(range(10, 100000, 10))
    return lambda: time.time() + next(ticks)
