"""Registered queries whose work must follow the tables: what a task holds, and what is done once."""

import re

import pytest
from pyspark.sql import functions as F

from gramlode import TableCorpus, catalog
from gramlode.functions.encodings import decode_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def own_indexes(monkeypatch):
    monkeypatch.setattr(catalog, "_BUILT", {})


def test_files_of_the_roots_stay_small(spark, monkeypatch):
    monkeypatch.setattr(catalog, "TEXTS_PER_FILE", 50)
    rows = catalog.QUERIES["union_of_roots"](spark, SF).collect()
    (index,) = catalog._BUILT.values()
    texts = spark.read.parquet(f"{SF}/documents.parquet").where("lang in ('en', 'de')")
    longest = texts.agg(F.max(F.octet_length("text"))).first()[0]
    assert index.files().agg(F.max("size")).first()[0] <= 50 * (longest + 1)
    assert index.files().count() >= texts.count() / 50
    lines = texts.select("lang", F.explode(F.split("text", "\n")).alias("line")).where(F.lower("line").contains("en"))
    assert {r.lang: r.n_hits for r in rows} == {r.lang: r["count"] for r in lines.groupBy("lang").count().collect()}


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", ["search_batch_either", "search_batch_regex"])
def test_no_row_for_each_gram_of_a_text(spark, monkeypatch, name):
    """Regexes that many documents can hold meet lines, not texts once for each of their grams."""
    monkeypatch.setitem(catalog.search_batch.__globals__, "BROADCAST_ROWS", 300)
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "MapInArrow" in text and "explode(grams" not in text


def test_a_word_asked_for_many_times_is_searched_for_once(spark, monkeypatch):
    asked = []
    run = catalog.search_batch
    monkeypatch.setattr(catalog, "search_batch", lambda index, queries, **kw: (asked.append(queries), run(index, queries, **kw))[1])
    rows = catalog.QUERIES["search_batch_words"](spark, SF).collect()
    (queries,) = asked
    assert queries.count() == queries.select("query").distinct().count() and len(rows) > 200
    assert queries.where("query rlike '[A-Z]'").count() == 0


def test_pairs_are_sorted_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(catalog, "PAIRS_OF_TASK", 10_000)
    pairs = catalog.QUERIES["postings_table"](spark, SF)
    (index,) = catalog._BUILT.values()
    tasks = -(-sum(s["postings"] for s in index.commit.segments) // 10_000)
    assert tasks > 3 and plan(pairs).count(f", {tasks}), REPARTITION_BY_NUM") >= 2 and "SortMergeJoin" in plan(pairs)


def test_lines_are_scanned_once_for_all_patterns(spark):
    text = plan(catalog.QUERIES["search_regex_fold"](spark, SF))
    assert text.count("Scan parquet") <= 2 * (1 + len(catalog.FOLD_PATTERNS))    # named in the tree and below


def test_texts_that_are_worked_out_are_so_once(spark):
    def spelled(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("windows-31j")

    corpus = catalog.japanese_texts(catalog.configure(spark), SF)
    assert spelled(corpus.texts()) == spelled(corpus.listing()) == 2         # one encoded, one decoded
    given = TableCorpus(catalog.japanese(spark, SF), path="doc_id", text=decode_text("content", "enc"), size="doc_id")
    assert spelled(given.listing()) == 0 and given.texts().columns == corpus.texts().columns


def test_kana_of_odd_texts(spark, tmp_path):
    """Nulls, marks, kana, characters beyond 16 bits and bytes that are no UTF-8, as two translations and a regex have them."""
    odd = ["Aé漢b", "", "あZぃ・がは", "x\U0001F600y\U00020BB7Z", "\x00\x7f\x80", "\ud7ff\ue000\uffff", "l\nQ\r\n", None]
    data = [None if t is None else t.encode() for t in odd] + [b"\xc3aB", b"\xffQ", b"\xe3\x81a", b"\xed\xa0\xbdz"]
    rows = spark.createDataFrame([(i, d, "en" if i % 2 else "de", "s") for i, d in enumerate(data)], "doc_id long, text binary, lang string, source string")
    rows = rows.withColumn("text", F.col("text").cast("string"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    want = rows.select("doc_id", F.expr(catalog.JAPANESE).alias("text"), F.expr(catalog.JAPANESE_SPARK).alias("now"))
    assert [r for r in want.select("doc_id", F.encode("text", "utf-8").alias("t"), F.encode("now", "utf-8").alias("n")).collect() if r.t != r.n] == []
    texts = {r.path: r.text for r in catalog.japanese_texts(catalog.configure(spark), str(tmp_path)).texts().collect()}
    turned = str.maketrans(dict(zip(catalog.UPPER + catalog.LOWER, 2 * catalog.KANA)))
    kept = {f"s/{i}": re.sub(f"[^\x00-\x7F{catalog.KANA}]", "・", t.translate(turned)) for i, t in enumerate(odd) if t is not None}
    assert {p: t for p, t in texts.items() if p in kept} == kept and len(texts) == len(data) - 1
    sizes = {r.path: r.size for r in catalog.japanese_texts(spark, str(tmp_path)).listing().collect()}
    assert sizes == {p: len(t.encode()) for p, t in texts.items()}
