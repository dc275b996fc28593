"""Searches on the driver's tables against brute force, batches of queries, and plans."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from gramlode import (
    TableCorpus, batch_errors, build_index, filter_paths, format_hits, fresh_folder, group_hits, json_array,
    json_lines, search, search_batch, search_summary, sync, write_json, write_text,
)
from gramlode.functions.text import ascii_lower_str
from gramlode.operators import index as index_module
from gramlode.plans import batch as batch_module
from gramlode.plans import search as search_module

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {str(r.doc_id): r.text for r in rows}


@pytest.fixture(scope="module")
def corpus(spark):
    return TableCorpus(spark.read.parquet(f"{SF}/documents.parquet"), path="doc_id")


@pytest.fixture(scope="module")
def index(spark, corpus):
    return build_index(corpus.texts(), fresh_folder(spark, "docs"))


def brute(texts, needle, case=False):
    """(file, line) of every line on which an occurrence starts, found by plain scanning."""
    out = set()
    fold = (lambda s: s) if case else ascii_lower_str
    needle = fold(needle)
    for name, t in texts.items():
        t, at = fold(t), 0
        while (at := t.find(needle, at)) >= 0:
            out.add((name, t.count("\n", 0, at) + 1))
            at += len(needle)
    return out


def brute_regex(texts, pattern, flags):
    rx = re.compile(pattern, flags)
    return {(n, i) for n, t in texts.items() for i, line in enumerate(t.split("\n"), 1) if rx.search(line)}


def everything(index, q, **kw):
    hits = search(index, q, max_results=None, per_file=None, **kw).hits
    return {(r.file, r.line) for r in hits.select("file", "line").collect()}


def test_random_substrings(index, texts, monkeypatch):
    rng = random.Random(7)
    names = sorted(texts)
    for k in range(14):
        t = texts[rng.choice(names)]
        a = rng.randrange(max(1, len(t) - 1))
        needle = t[a : a + rng.choice((2, 3, 5, 9, 30))]
        if len(needle) < 2:
            continue
        case = bool(k % 2)
        assert everything(index, needle, case_sensitive=case) == brute(texts, needle, case), needle


def test_every_strategy_gives_the_same(index, texts, corpus, monkeypatch):
    want = brute(texts, "tion")
    assert everything(index, "TION") == want
    assert everything(index, "tion", corpus=corpus) == want
    monkeypatch.setattr(search_module, "LOOKUP_STEP", 10**6)
    monkeypatch.setattr(search_module, "LOOKUP_ROWS", 10**6)
    assert everything(index, "tion") == want
    monkeypatch.setattr(search_module, "LOOKUP_ROWS", 0)
    assert everything(index, "tion") == want
    assert everything(index, "worthless|tion", regex=True, prefilter="compat") == {
        h for h in want | brute(texts, "worthless") if h[0] in {f for f, _ in brute(texts, "worthless")} & {f for f, _ in want}
    }


@pytest.mark.parametrize("pattern", ["th[a-e]+r", "foo|tion", "(ing)?est", r"\bthe\b.*tion", "x{0,2}worth", "wor+th?"])
def test_regexes(index, texts, pattern):
    assert everything(index, pattern, regex=True) == brute_regex(texts, pattern, re.I)
    assert everything(index, pattern, regex=True, case_sensitive=True) == brute_regex(texts, pattern, 0)


def batch_queries(spark, texts):
    rng = random.Random(3)
    plain = ["tion", "The", "qu", "zqxvzq", "q", "e.\nth", "worthless"]
    some = [t[5:25] for t in rng.sample(sorted(texts.values()), 6) if len(t) > 30]
    rows = [(i, q, False, bool(i % 3 == 0), None) for i, q in enumerate(plain + some)]
    rows += [(100, "th[a-e]+r", True, False, None), (101, "foo|bar", True, False, None), (102, r"\d+", True, False, None),
             (103, "tion", False, False, 2)]
    return rows, spark.createDataFrame(rows, "query_id long, query string, regex boolean, case_sensitive boolean, max int")


def test_batch_equals_single(spark, index, texts, monkeypatch):
    rows, queries = batch_queries(spark, texts)
    want = set()
    for i, q, rx, case, cap in rows:
        if i in (101, 102):
            continue
        hits = search(index, q, regex=rx, case_sensitive=case, max_results=cap)
        want |= {(i, r.file, r.line, r.text) for r in hits.hits.collect()}

    def run():
        return {tuple(r) for r in search_batch(index, queries, max_results=None).collect()}

    assert run() == want                                   # short candidate lists are broadcast
    monkeypatch.setattr(batch_module, "lookup_limit", lambda index: 10**6)
    assert run() == want                                   # documents are fetched by number
    monkeypatch.setattr(batch_module, "lookup_limit", lambda index: 0)
    monkeypatch.setattr(batch_module, "LOOKUP_ROWS", 0)
    assert run() == want                                   # queries are broadcast to the postings
    monkeypatch.setattr(batch_module, "BROADCAST_ROWS", 50)
    assert run() == want                                   # queries are broadcast to the documents' grams
    monkeypatch.setattr(batch_module, "BROADCAST_ROWS", 0)
    assert run() == want                                   # nothing is broadcast
    assert {r.query_id for r in batch_errors(queries).collect()} == {101, 102}
    top = search_batch(index, queries, max_results=5).groupBy("query_id").count().collect()
    assert max(r["count"] for r in top) == 5


def test_segments_chunks_and_buckets(spark, corpus, texts, monkeypatch):
    """A build of many small chunks, buckets and blocks gives the same answers."""
    monkeypatch.setattr(index_module, "SEGMENT_TASKS", 16)
    monkeypatch.setattr(index_module, "POSTINGS_PER_BUCKET", 5000)
    monkeypatch.setattr(index_module, "PATHS_PER_BUCKET", 20)
    monkeypatch.setattr(index_module, "BLOCK_BITS", 2)
    many = build_index(corpus.texts().repartition(40), fresh_folder(spark, "chunks"))
    segment = many.commit.segments[0]
    assert segment["buckets"] > 5 and segment["path_buckets"] > 5
    assert everything(many, "tion") == brute(texts, "tion")
    some = texts["17"][3:23]
    assert everything(many, some) == brute(texts, some)
    changed = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.concat(F.lit("changed "), "text"))
    synced, stats = sync(many, TableCorpus(changed, path="doc_id", mtime=F.lit(1)))
    assert (stats.updated, stats.removed) == (len(texts), 0)
    assert len(everything(synced, "changed ")) >= len(texts)
    monkeypatch.setattr(index_module, "BROADCAST_ROWS", 0)
    assert {f for f, _ in everything(synced, "changed ")} == set(texts)


def test_hits_output(spark, index, tmp_path):
    hits = search(index, "worth", max_results=20).hits
    n = hits.count()
    assert tuple(search_summary(hits).first()) == (n, hits.select("file").distinct().count(), False)
    grouped = group_hits(hits).collect()
    assert sum(g.n_hits for g in grouped) == n and all(len(g.rows) == g.n_hits for g in grouped)
    assert format_hits(hits).count() == n and json_lines(hits).count() == n
    assert json_array(hits).first().value.count('"file"') == n
    write_json(hits, str(tmp_path / "j"))
    write_text(hits, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "j")).columns == ["file", "line", "text"]
    assert spark.read.text(str(tmp_path / "t")).count() == n
    one = hits.first().file
    assert {r.file for r in filter_paths(hits, include=one).collect()} >= {one}
    assert one not in {r.file for r in filter_paths(hits, exclude=one).collect()}


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_plans(index, texts):
    common = plan(search(index, "tion").hits)
    assert "TakeOrderedAndProject" in common and "Exchange" not in common
    assert "grams:array" not in common                     # column pruning
    rare = plan(search(index, texts["17"][3:23]).hits)
    pushed = next(line for line in rare.splitlines() if line.startswith("PushedFilters"))
    assert "Exchange" not in rare and ("In(doc" in pushed or "EqualTo(doc" in pushed)
    assert "PartitionFilters" in rare and "part" in rare
    lookup = plan(index.postings(["tio"]))
    assert "PartitionFilters" in lookup and "bucket" in lookup and "PushedFilters" in lookup


def test_registered_queries_have_matching_rows(spark):
    from tests.compare import compare, database

    con = database(SF)
    for name in ("search_substring_ci", "multiline_needle", "candidate_topk", "match_spans", "sync_index", "debounce_batches"):
        problem = compare(spark, con, name, SF)[0]
        assert problem is None, (name, problem)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(entry.SMOKE_DIR)
