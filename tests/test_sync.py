"""Syncing, change batches, compaction, rebuilds and the stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gramlode import (
    FileCorpus, TableCorpus, apply_changes, build_index, compact, debounce, follow, fresh_folder, index_status,
    is_built, open_index, read_changes, search, search_fresh, sync, vacuum,
)
from gramlode.operators import sync as syncing


def test_sync_new_changed_deleted_unchanged(tree, later):
    t = tree()
    t.write("same.txt", "constant words")
    t.write("old.txt", "before words")
    t.write("gone.txt", "vanishing words")
    t.build()
    t.index, stats = sync(t.index, t.corpus())
    assert (stats.updated, stats.removed) == (0, 0)

    t.write("new.txt", "arrived words")
    t.write("old.txt", "after words", later())
    (t.folder / "gone.txt").unlink()
    t.index, stats = sync(t.index, t.corpus())
    assert (stats.updated, stats.removed) == (2, 1)
    assert {f for f, _ in t.lines("words")} == {"same.txt", "old.txt", "new.txt"}
    assert t.lines("before") == [] and t.lines("after") == [("old.txt", 1)]
    assert t.index.commit.file_count == t.index.files().count() == 3

    t.index, stats = sync(t.index, t.corpus())
    assert (stats.updated, stats.removed) == (0, 0)
    folded = compact(t.index)
    assert len(folded.commit.segments) == 1 and folded.commit.retired == 0
    t.index = folded
    assert {f for f, _ in t.lines("words")} == {"same.txt", "old.txt", "new.txt"}
    assert open_index(t.spark, t.where).commit == folded.commit
    assert any(n.startswith("docs/") for n in vacuum(folded)) and vacuum(folded) == []
    assert {f for f, _ in t.lines("words")} == {"same.txt", "old.txt", "new.txt"}


def test_files_that_stop_qualifying(tree, later):
    for compat in (False, True):
        t = tree(max_bytes=100)
        for name in ("big.txt", "bin.txt", "ign.txt", "ok.txt"):
            t.write(name, "needle", later())
        ign = t.folder / ".ignore"
        if ign.exists():
            ign.unlink()
        t.build()
        t.write("big.txt", "needle" + "x" * 200, later())
        t.write("bin.txt", b"needle\x00", later())
        t.write(".ignore", "ign.txt\n")
        t.index, stats = sync(t.index, t.corpus(), compat=compat)
        left = {f for f, _ in t.lines("needle")}
        assert left == ({"big.txt", "bin.txt", "ign.txt", "ok.txt"} if compat else {"ok.txt"})
        assert stats.updated == 0 and stats.removed == (0 if compat else 3)


def test_stale_index_verifies_present_content(tree):
    t = tree(store_text=False)
    t.write("a.txt", "one needle")
    t.write("b.txt", "two needle")
    t.build()
    t.write("a.txt", "\nmoved needle")
    (t.folder / "b.txt").unlink()
    assert t.hits("needle") == [("a.txt", 2, "moved needle")]
    t.index, out = search_fresh(t.index, "moved", t.corpus())
    assert out.hits.count() == 1


def test_failed_sync_fails_a_fresh_search(tree, later, monkeypatch):
    t = tree()
    t.write("a.txt", "old needle")
    t.build()
    t.write("b.txt", "new needle", later())
    corpus, listing = t.corpus(), FileCorpus.listing

    def failing(self):
        raise OSError("no listing")

    monkeypatch.setattr(FileCorpus, "listing", failing)
    with pytest.raises(OSError, match="no listing"):
        search_fresh(t.index, "needle", corpus)
    assert search(t.index, "needle").hits.count() == 1      # the last state, asked for as such
    monkeypatch.setattr(FileCorpus, "listing", listing)
    _, out = search_fresh(t.index, "needle", corpus)
    assert out.hits.count() == 2


def test_documents_without_a_path(spark):
    """A fresh search answers from the later state, also where paths are null."""
    def corpus(*rows):
        return TableCorpus(spark.createDataFrame(rows, "path string, text string, changed long"), mtime="changed")

    def fresh(index, *rows):
        index, out = search_fresh(index, "needle", corpus(*rows), max_results=None)
        found = sorted(((h.file, h.text) for h in out.hits.collect()), key=str)
        assert index.commit.file_count == index.files().count() == len(rows)
        return index, found

    index = build_index(corpus((None, "needle 1", 0), (None, "needle 2", 0), ("a", "needle 3", 0), ("b", "needle 4", 0)).texts(), fresh_folder(spark, "t"))
    later = [(None, "needle 1", 0), (None, "needle 5", 0), (None, "needle 5", None), ("a", "needle 6", 1)]
    index, found = fresh(index, *later)
    assert found == sorted(((p, t) for p, t, _ in later), key=str)
    index, stats = apply_changes(index, spark.createDataFrame([(None,), ("a",)], "path string"), corpus((None, "needle 7", 0), ("a", "needle 8", 0)))
    assert (stats.updated, stats.removed) == (2, 0) and index.commit.file_count == 2
    index, found = fresh(index, ("a", "needle 8", 0))
    assert found == [("a", "needle 8")]


def test_build_without_force_keeps_vanished(tree, later):
    t = tree()
    t.write("a.txt", "needle old")
    t.write("b.txt", "needle")
    t.build()
    t.write("a.txt", "needle new", later())
    (t.folder / "b.txt").unlink()
    t.index = build_index(t.corpus().texts(), t.where, force=False)
    assert {x for _, _, x in t.hits("needle")} == {"needle new", "needle"}
    t.index = build_index(t.corpus().texts(), t.where)
    assert {x for _, _, x in t.hits("needle")} == {"needle new"}


def test_change_batch(tree, later):
    t = tree({"in": "utf-8"})
    t.write("in/a.txt", "alpha")
    t.write("in/b.txt", "beta")
    t.build()
    t.write("in/a.txt", "gamma", later())
    (t.folder / "in/b.txt").unlink()
    t.write("in/c.txt", "delta")
    t.write("out/d.txt", "delta outside")
    t.write("in/.e.txt", "delta hidden")
    names = ("in/a.txt", "in/b.txt", "in/c.txt", "out/d.txt", "in/never.txt", "in/.e.txt", "in/a.txt")
    root = str(t.folder.resolve())
    paths = t.spark.createDataFrame([(f"{root}/{n}",) for n in names], "path string")
    t.index, stats = apply_changes(t.index, paths, t.corpus(), "b-1")
    assert (stats.updated, stats.removed) == (2, 1)
    assert t.lines("alpha") == [] and t.lines("gamma") == [("in/a.txt", 1)]
    assert t.lines("beta") == [] and t.lines("delta") == [("in/c.txt", 1)]
    again, stats = apply_changes(t.index, paths, t.corpus(), "b-1")
    assert again.commit.version == t.index.commit.version and stats.updated == 0


def test_follow_stream(tree, spark, tmp_path, later):
    t = tree({"src": "utf-8"})
    t.write("src/a.txt", "first words")
    t.build()
    landing, root = tmp_path / "events", str((t.folder / "src").resolve())

    def event(name, kind, second):
        ts = dt.datetime(2024, 1, 1, 0, 0, second)
        row = spark.createDataFrame([(root, f"{root}/{name}", kind, ts)], "root string, path string, kind string, ts timestamp")
        row.write.mode("append").parquet(str(landing))

    t.write("src/a.txt", "second words", later())
    t.write("src/b.txt", "more words")
    t.write("src/c.txt", "unseen words")
    event("a.txt", "modify", 0)
    event("b.txt", "create", 1)
    event("c.txt", "access", 2)
    for _ in range(2):  # the second start has nothing left to do
        query = follow(read_changes(spark, str(landing)), t.where, t.corpus(), str(tmp_path / "mark"),
                       trigger={"availableNow": True})
        query.awaitTermination()
    t.index = open_index(spark, t.where)
    assert {x for _, _, x in t.hits("words")} == {"second words", "more words"}
    (t.folder / "src/b.txt").unlink()
    event("b.txt", "remove", 3)
    follow(read_changes(spark, str(landing)), t.where, t.corpus(), str(tmp_path / "mark"),
           trigger={"availableNow": True}, compact_after=1).awaitTermination()
    t.index = open_index(spark, t.where)
    assert {x for _, _, x in t.hits("words")} == {"second words"}
    assert len(t.index.commit.segments) == 1


def test_debounce_exact_gap(spark):
    base = dt.datetime(2024, 1, 1, 0, 59, 59)
    at = lambda ms: base + dt.timedelta(milliseconds=ms)
    rows = [("r", "a", "create", at(0)), ("r", "b", "modify", at(800)), ("r", "a", "modify", at(1600)),
            ("r", "x", "access", at(2000)), ("r", "c", "remove", at(2401)), ("q", "a", "create", at(2401))]
    events = spark.createDataFrame(rows, "root string, path string, kind string, ts timestamp")
    got = {(r.root, r.path, r.n_events, (r.start - base) // dt.timedelta(milliseconds=1)) for r in debounce(events).collect()}
    assert got == {("r", "a", 2, 0), ("r", "b", 1, 0), ("r", "c", 1, 2401), ("q", "a", 1, 2401)}


def test_debounce_matches_plain_sessions(spark):
    rows = spark.range(3000).selectExpr(
        "cast(id % 3 as string) root", "cast(pmod(hash(id), 40) as string) path", "'modify' kind",
        "timestamp_seconds(1704067200 + pmod(hash(id, 7), 200000)) ts",
    )
    plain = rows.groupBy("root", F.session_window("ts", "90 seconds").alias("w")).agg(F.count("*").alias("n"))
    want = {(r.root, r.start, r.n) for r in plain.select("root", "w.start", "n").collect()}
    ours = debounce(rows, "89 seconds").groupBy("root", "start").agg(F.sum("n_events").alias("n"))
    strict = {(r.root, r.start, r.n) for r in ours.collect()}
    plain89 = rows.groupBy("root", F.session_window("ts", "89 seconds").alias("w")).agg(F.count("*").alias("n"))
    want89 = {(r.root, r.start, r.n) for r in plain89.select("root", "w.start", "n").collect()}
    assert strict == want89 and want != want89


def test_two_writers_cannot_both_commit(tree):
    t = tree()
    t.write("a.txt", "needle")
    t.build()
    stale = t.index
    sync(t.index, t.corpus())
    with pytest.raises(FileExistsError):
        sync(stale, t.corpus())


def test_status_and_missing_index(spark, tree):
    where = fresh_folder(spark, "none")
    assert not is_built(spark, where)
    with pytest.raises(FileNotFoundError):
        open_index(spark, where)
    row = index_status(spark, where).first()
    assert (row.built, row.file_count, row.size_bytes, row.last_build) == (False, 0, 0, None)
    t = tree()
    t.write("a.txt", "needle")
    t.build()
    row = index_status(spark, t.where).first()
    assert row.built and row.file_count == 1 and row.size_bytes > 0 and row.last_build is not None


def test_empty_corpus(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    index = build_index(FileCorpus(spark, [(str(tmp_path / "empty"), "utf-8")]).texts(), fresh_folder(spark, "empty"))
    assert index.commit.file_count == 0 and index.files().count() == 0
    assert search(index, "needle").hits.count() == 0
    rows = spark.createDataFrame([("a", "needle"), ("b", None), ("c", ""), ("d", "x")], "path string, text string")
    index, stats = sync(index, TableCorpus(rows))
    assert stats.updated == 3 and search(index, "needle").hits.count() == 1


def test_diff_tables(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 5), ("d", 1, 5)], "path string, mtime long, size long")
    new = spark.createDataFrame([("a", 1, 5), ("b", 0, 5), ("d", 1, 999), ("e", 1, 5)], "path string, mtime long, size long")
    diff = {(r.path, r.action) for r in syncing.sync_diff(new, old, 100).collect()}
    assert diff == {("b", "update"), ("c", "remove"), ("d", "update"), ("e", "update")}
    assert tuple(syncing.sync_stats(syncing.sync_diff(new, old)).first()) == (2, 1)
    merged = syncing.upsert(old, syncing.changed_files(new, old), syncing.deleted_files(new, old))
    assert {(r.path, r.mtime) for r in merged.collect()} == {("a", 1), ("b", 0), ("d", 1), ("e", 1)}
