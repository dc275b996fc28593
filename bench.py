"""Headline runs on the ``documents`` table: prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from gramlode import TableCorpus, build_index, catalog, fresh_folder, local_session, search, search_batch, sync
from gramlode.functions.encodings import decode_text

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 3
COPIES = 8


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, "gramlode-bench", os.environ.get("BENCH_MEMORY", "12g"))
    corpus = catalog.documents(spark, SF_DIR)
    state: dict = {}

    def build():
        state["index"] = build_index(corpus.texts(), fresh_folder(spark, "bench"))

    def find(text, **kw):
        return lambda: drain(search(state["index"], text, **kw).hits)

    def no_change():
        state["index"], stats = sync(state["index"], corpus)
        assert (stats.updated, stats.removed) == (0, 0)

    def batch():
        items = catalog.table(spark, SF_DIR, "benchmark")
        queries = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
        drain(search_batch(state["index"], queries))

    def needles(n):
        def run():
            drain(search_batch(state["index"], state["words"].limit(n)))

        return run

    text = catalog.table(spark, SF_DIR, "documents")
    words = text.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{8,})")))).alias("query")).distinct()
    words.orderBy(F.xxhash64("query")).limit(10_000).select(F.xxhash64("query").alias("query_id"), "query").write.parquet(asked := fresh_folder(spark, "words"))
    state["words"] = spark.read.parquet(asked)
    # a corpus of copies under paths of their own, large enough for an index to matter
    many = text.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    many = many.withColumn("text", F.concat("text", F.lit("\ncopy "), F.col("copy").cast("string")))
    many.write.parquet(fresh := fresh_folder(spark, "copies"))
    many = spark.read.parquet(fresh)
    wide = TableCorpus(many, path=F.concat(catalog.doc_path(), F.lit("/"), F.col("copy").cast("string")), root="source", mtime="n_chars")

    def build_wide():
        state["wide"] = build_index(wide.texts(), fresh_folder(spark, "bench"))

    catalog.japanese(spark, SF_DIR).write.parquet(kana := fresh_folder(spark, "kana"))

    def build_japanese():
        files = TableCorpus(spark.read.parquet(kana), path=catalog.doc_path(), text=decode_text("content", "enc"))
        state["kana"] = build_index(files.texts(), fresh_folder(spark, "bench"))

    def find_in(name, text, **kw):
        return lambda: drain(search(state[name], text, **kw).hits)

    runs = {
        "build_index": build,
        "search_specific": find("worthless | o"),
        "search_common": find("tion"),
        "search_common_all_hits": find("tion", max_results=None),
        "search_two_char": find("qu"),
        "search_no_hit": find("zqxvzq"),
        "search_regex": find("th[a-e]+r.*tion", regex=True),
        "search_regex_either": find("worthless|inoran the", regex=True),
        "search_multiline": find(".\nTh"),
        "search_batch_passages": batch,
        "search_batch_1000_words": needles(1_000),
        "search_batch_10000_words": needles(10_000),
        "sync_no_change": no_change,
        "build_japanese": build_japanese,
        "search_shift_jis": find_in("kana", "とけそせ かそつ"),
        "build_copies": build_wide,
        "copies_search_specific": find_in("wide", "worthless | o"),
        "copies_search_no_hit": find_in("wide", "zqxvzq"),
        "copies_search_regex_either": find_in("wide", "worthless | o|inoran the d", regex=True),
        "copies_search_common": find_in("wide", "tion"),
        "copies_control_scan": lambda: drain(many.where(F.contains(F.lower("text"), F.lit("worthless | o")))),
        "control_scan_contains": lambda: drain(text.where(F.contains(F.lower("text"), F.lit("tion")))),
    }
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()
    took: dict[str, float] = {}
    for name, run in runs.items():
        times = []
        for _ in range(1 if name in ("build_japanese", "build_copies") else 2 if name == "build_index" else REPEATS):
            t0 = time.perf_counter()
            run()
            times.append(time.perf_counter() - t0)
        took[name] = round(min(times) if name == "build_index" else statistics.median(times), 3)
    n = state["index"].commit.file_count
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")),
        "files": n, "build_files_per_sec": round(n / took["build_index"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
