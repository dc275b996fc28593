"""What must not change with size: strategies, read errors, deep trees, two writers, folding."""

import datetime as dt
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from gramlode import (
    FileCorpus, TableCorpus, apply_changes, build_index, compact, flush, foldable, follow, fresh_folder, open_index, read_changes, search,
    search_batch, sync, with_flush,
)
from gramlode.functions.regex import java_regex
from gramlode.plans import batch as batching
from gramlode.plans import search as searching
from gramlode.sources import tree as walking
from gramlode.sources.folder import Folder

ODD = {"dotted": "İstanbul", "dotless": "ıstanbul", "long": "iſtanbul", "kelvin": "Keit", "plain": "ISTANBUL keit"}
PATTERNS = {
    "istanbul": {"plain", "long"}, "[h-j]stanbul": {"plain", "long"}, "[^a-h]stanbul": {"dotted", "dotless", "plain", "long"},
    "İstanbul": {"dotted"}, "[ıx]stanbul": {"dotless"}, r"\wstanbul": {"dotted", "dotless", "plain", "long"},
    "keit": {"kelvin", "plain"}, "[j-l]eit": {"kelvin", "plain"}, r"\x69stanbul": {"plain", "long"}, "(?-i:i)stanbul": {"long"},
}


@pytest.mark.parametrize("filler", [2, 300])
def test_regex_folding_is_the_same_by_lookup_scan_and_batch(spark, filler):
    rows = [*ODD.items(), *((f"f{k}", f"nothing here {k}") for k in range(filler))]
    df = spark.createDataFrame(rows, "path string, text string")
    index = build_index(TableCorpus(df).texts(), fresh_folder(spark, "t"))
    for pattern, want in PATTERNS.items():
        hits = search(index, pattern, regex=True, allow_scan=True, max_results=None).hits
        assert {h.file for h in hits.collect()} == want, pattern
        assert {r.path for r in df.where(F.col("text").rlike(java_regex(pattern))).collect()} == want, pattern
    asked = spark.createDataFrame([(k, p, True) for k, p in enumerate(PATTERNS)], "query_id long, query string, regex boolean")
    got = {}
    for h in search_batch(index, asked).collect():
        got.setdefault(list(PATTERNS)[h.query_id], set()).add(h.file)
    refused = {p for p in PATTERNS if p not in got}
    assert all(got[p] == PATTERNS[p] for p in got) and "istanbul" in got and "keit" in got
    assert all(not searching.compile_query(p, True, allow_scan=True).grams for p in refused)


def table_index(spark, n=260):
    df = spark.createDataFrame([(f"p{k:04}", f"common words number {k}\ncommon again") for k in range(n)], "path string, text string")
    return build_index(TableCorpus(df).texts(), fresh_folder(spark, "t")), df


def test_a_querys_own_limit_counts(spark):
    index, _ = table_index(spark)
    asked = spark.createDataFrame([(1, "common", 500), (2, "common", 7), (3, "common", None)], "query_id long, query string, max int")
    for default, third in ((300, 300), (40, 40), (None, 520)):
        counts = {r.query_id: r["count"] for r in search_batch(index, asked, max_results=default).groupBy("query_id").count().collect()}
        assert counts == {1: 500, 2: 7, 3: third}


def test_early_stop_gives_the_same_rows(spark, monkeypatch):
    index, _ = table_index(spark)
    want = search(index, "common", max_results=30).hits.collect()
    monkeypatch.setattr(searching, "EARLY_STOP_DOCS", 0)
    monkeypatch.setattr(searching, "EARLY_STOP_STEP", 10)
    monkeypatch.setattr(searching, "lookup_limit", lambda index: 5)
    assert search(index, "common", max_results=30).hits.collect() == want
    assert search(index, "number 25", max_results=300).hits.count() == 11


def test_rows_do_not_depend_on_broadcast_limits(spark, monkeypatch):
    index, df = table_index(spark)
    asked = spark.createDataFrame([(1, "number 12", None), (2, "again", None)], "query_id long, query string, max int")
    want = sorted(search_batch(index, asked, max_results=None).collect())
    for module in (batching,):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    assert sorted(search_batch(index, asked, max_results=None).collect()) == want
    import gramlode.sources.tables as tables

    found = search(index, "common", max_results=None, corpus=TableCorpus(df)).hits
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    again = search(index, "common", max_results=None, corpus=TableCorpus(df)).hits
    assert sorted(again.collect()) == sorted(found.collect())


def test_a_lookup_reads_the_folders_of_its_grams_only(spark):
    index, _ = table_index(spark)
    index.commit.segments[0]["buckets"] = index.commit.segments[0]["buckets"]
    folders = {os.path.dirname(f) for f in index.postings(["com"]).inputFiles()}
    assert len(folders) <= len(index.commit.segments)
    assert index.postings(["☃☃☃"]).count() == 0


def test_listing_of_a_table_reads_no_text(spark, tmp_path):
    spark.createDataFrame([("a", "text one", 8), ("b", None, None)], "path string, text string, size long").write.parquet(str(tmp_path / "t"))
    corpus = TableCorpus(spark.read.parquet(str(tmp_path / "t")), size="size")
    plan = corpus.listing()._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema:")[1]
    assert [r.path for r in corpus.listing().collect()] == ["a"]


def test_no_size_cap(spark, tmp_path):
    (tmp_path / "big.txt").write_text("needle " * 400000)
    assert FileCorpus(spark, [(str(tmp_path), "utf-8")], tasks=1).texts().count() == 0
    assert FileCorpus(spark, [(str(tmp_path), "utf-8")], tasks=1, max_bytes=None).texts().count() == 1


def test_an_error_is_not_taken_for_a_deleted_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first needle")
    (tmp_path / "b.txt").write_text("second needle")
    corpus = FileCorpus(spark, [(str(tmp_path), "utf-8")], tasks=1)
    where = fresh_folder(spark, "t")
    index = build_index(corpus.texts(), where)
    corpus.refresh()
    corpus.refresh = lambda: corpus
    # listed as a file that changed, but reading it fails with something else than "not found"
    corpus.listing = lambda real=corpus.listing: real().withColumn("mtime", F.col("mtime") + 1)
    (tmp_path / "a.txt").unlink()
    (tmp_path / "a.txt").mkdir()
    with pytest.raises(Exception, match="a.txt"):
        sync(index, corpus)
    assert open_index(spark, where).commit.file_count == 2
    with pytest.raises(OSError):
        walking.visit(*walking.open_fs(str(tmp_path / "b.txt")), walking.Rules(), True)
    assert walking.visit(*walking.open_fs(str(tmp_path / "gone")), walking.Rules(), True) == ([], [])


def test_deep_and_wide_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walking, "FOLDERS_AT_ONCE", 3)
    deep = tmp_path / "src/main/java/com"
    for k in range(40):
        (deep / f"p{k}").mkdir(parents=True)
        for name in ("a.txt", "b.log", ".hidden"):
            (deep / f"p{k}" / name).write_text("needle")
    (tmp_path / ".ignore").write_text("*.log\np3*/\n")
    (deep / "p1" / ".ignore").write_text("!b.log\n")
    corpus = FileCorpus(spark, [(str(tmp_path), "utf-8")], tasks=2)
    got = {r.path for r in corpus.listing().collect()}
    kept = [k for k in range(40) if k != 3 and not 30 <= k < 40]
    assert got == {str(deep / f"p{k}/a.txt") for k in kept} | {str(deep / "p1/b.log")}
    rounds = spark.read.parquet(corpus._table).groupBy("round").count().count()
    assert rounds > 2  # the folders were dealt out again on the way down
    before = corpus._table
    assert corpus.refresh()._table != before and not Folder(spark, before).exists()


def test_global_excludes(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    for name in ("a.txt", "b.tmp", "c.tmp"):
        (tmp_path / "tree" / name).write_text("needle")
    (tmp_path / "tree/.ignore").write_text("!c.tmp\n")
    (tmp_path / "excludes").write_text("*.tmp\n")
    corpus = FileCorpus(spark, [(str(tmp_path / "tree"), "utf-8")], excludes=str(tmp_path / "excludes"), tasks=1)
    assert {os.path.basename(r.path) for r in corpus.listing().collect()} == {"a.txt", "c.tmp"}
    paths = spark.createDataFrame([(str(tmp_path / "tree" / n),) for n in ("a.txt", "b.tmp", "c.tmp", "gone")], "path string")
    assert {os.path.basename(r.path) for r in corpus.texts_now(paths).collect()} == {"a.txt", "c.tmp"}


def test_one_of_two_writers_at_once_wins(spark):
    folder, won, lost = Folder(spark, fresh_folder(spark, "t")), [], []
    folder.create_text("first", "x")

    def write(k):
        try:
            Folder(spark, folder.path).create_text("commit.json", f"writer {k}")
            won.append(k)
        except FileExistsError:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 7 and folder.read_text("commit.json") == f"writer {won[0]}"
    assert not any("draft" in n for n in folder.names())


def test_many_batches_never_rewrite_the_large_segment():
    segments, written = [{"id": "large", "files": 1_000_000}], 0
    for k in range(200):
        segments.append({"id": f"s{k}", "files": 10})
        if chosen := foldable(segments, 50):
            assert "large" not in chosen
            merged = sum(s["files"] for s in segments if s["id"] in chosen)
            written += merged
            segments = [s for s in segments if s["id"] not in chosen] + [{"id": f"m{k}", "files": merged}]
    assert len(segments) <= 51 and written < 10_000 and sum(s["files"] for s in segments) == 1_002_000


def test_some_segments_are_folded(spark):
    index, _ = table_index(spark, 40)
    for k in range(3):
        df = spark.createDataFrame([("p0001", f"changed {k}"), (f"new{k}", "common new")], "path string, text string")
        index, _ = apply_changes(index, df.select("path"), TableCorpus(df))
    big = index.commit.segments[0]["id"]
    folded = compact(index, [s["id"] for s in index.commit.segments[1:]])
    assert [s["id"] for s in folded.commit.segments][0] == big and len(folded.commit.segments) == 2
    assert folded.commit.file_count == 43 and folded.files().count() == 43 and folded.commit.retired == 1
    assert [h.text for h in search(folded, "changed").hits.collect()] == ["changed 2"]
    whole = compact(folded)
    assert whole.commit.retired == 0 and whole.files().count() == 43


def test_many_saves_make_one_document(tree, spark, tmp_path):
    t = tree({"src": "utf-8"})
    t.write("src/a.txt", "first words")
    t.build()
    landing, root = tmp_path / "events", str((t.folder / "src").resolve())

    def save(k):
        t.write("src/a.txt", f"words of save {k}", time.time() + 10 * k)
        row = spark.createDataFrame([(root, f"{root}/a.txt", "modify", dt.datetime(2024, 1, 1))], "root string, path string, kind string, ts timestamp")
        row.write.mode("append").parquet(str(landing))

    save(1)
    query = follow(read_changes(spark, str(landing)), t.where, t.corpus(), str(tmp_path / "mark"), gap="6 seconds", trigger={"processingTime": "200 milliseconds"})
    try:
        for k in range(2, 11):
            save(k)
        deadline = time.time() + 90
        while time.time() < deadline and open_index(spark, t.where).commit.version < 2:
            time.sleep(0.5)
        time.sleep(1)
    finally:
        query.stop()
    index = open_index(spark, t.where)
    assert index.commit.version == 2 and len(index.commit.segments) == 2
    assert [h.text for h in search(index, "words").hits.collect()] == ["words of save 10"]


def test_flush_gives_the_tail_out(spark, tmp_path):
    from gramlode import debounce_stream

    landing, marks = str(tmp_path / "events"), str(tmp_path / "marks")
    rows = [("r", "a", "modify", dt.datetime(2024, 1, 1, 0, 0, s)) for s in range(3)] + [("r", "b", "modify", dt.datetime(2024, 1, 1, 0, 0, 9))]
    spark.createDataFrame(rows, "root string, path string, kind string, ts timestamp").write.parquet(landing)
    spark.createDataFrame([], "root string, path string, kind string, ts timestamp").write.parquet(marks)
    runs = debounce_stream(with_flush(read_changes(spark, landing), marks), "5 seconds", "0 seconds")

    def drain():
        sink = runs.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True)
        sink.start(str(tmp_path / "out")).awaitTermination()
        return {(r.path, r.n_events) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert drain() == {("a", 3)}
    flush(spark, marks)
    assert drain() == {("a", 3), ("b", 1)}


def test_many_best_candidates_stay_off_the_driver(spark, monkeypatch):
    index, _ = table_index(spark)
    want = [tuple(h) for h in search(index, "common", candidate_limit=100, max_results=None).hits.collect()]
    monkeypatch.setattr(searching, "LOOKUP_MOST", 10)
    monkeypatch.setattr(index, "docs_numbered", None)  # not asked for single numbers
    out = search(index, "common", candidate_limit=100, max_results=None)
    assert [tuple(h) for h in out.hits.collect()] == want and len(want) == 200 and out.candidates_truncated
    assert not search(index, "common", candidate_limit=200_000, max_results=None).candidates_truncated
    assert out.hits._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
