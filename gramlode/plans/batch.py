"""Many searches at once: a table of queries against one index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlode.constants import BROADCAST_BYTES, BROADCAST_ROWS, HITS_PER_FILE, LOOKUP_ROWS, MAX_RESULTS, PREFILTER_GRAMS
from gramlode.functions.regex import java_regex
from gramlode.functions.text import ascii_lower, ascii_lower_str, lines_of, without_return
from gramlode.operators.index import Index
from gramlode.operators.lines import (
    first_trimmed,
    spanning_lines,
    substring_pattern,
)
from gramlode.plans.meetings import meeting_lines, meeting_queries
from gramlode.plans.needles import needle_hits
from gramlode.plans.search import compile_query, lookup_limit
from gramlode.session import fresh_folder, small_batches

COMPILED_SCHEMA = (
    "query_id bigint, query string, regex boolean, case_sensitive boolean, max int, "
    "options array<array<string>>, needle string, pattern string, error string"
)
NEEDLES_TOGETHER = 16    # so many substrings are worth a pass of their own
NO_GRAMS = "no literal that every match contains: search for this pattern on its own"


def compile_queries(queries: DataFrame) -> DataFrame:
    """Sets of grams and line pattern of each query; ``error`` tells why one cannot be answered.

    ``queries`` has ``query_id`` and ``query``, and may have ``regex``, ``case_sensitive`` and
    ``max``. This is the only Python on the way, and it sees queries, never texts.
    """
    have = queries.columns
    full = queries.select(
        F.col("query_id").cast("bigint").alias("query_id"),
        "query",
        *(
            (F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in have else F.lit(False)).alias(c)
            for c in ("regex", "case_sensitive")
        ),
        (F.col("max").cast("int") if "max" in have else F.lit(None).cast("int")).alias("max"),
    )
    return full.mapInPandas(_compile, COMPILED_SCHEMA)


def _compile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def one(query: str, regex: bool, case: bool) -> tuple:
        try:
            options = compile_query(query, regex, case).tree.options()
            pattern = java_regex(query, case) if regex else substring_pattern(query, case)
        except ValueError as e:
            return [], None, None, str(e)
        needle = query if case else ascii_lower_str(query)
        return options, needle, pattern, NO_GRAMS if regex and not options else None

    for batch in batches:
        done = [one(q, r, c) for q, r, c in zip(batch["query"], batch["regex"], batch["case_sensitive"])]
        yield batch.assign(
            max=batch["max"].astype("Int32"),
            options=[d[0] for d in done], needle=[d[1] for d in done],
            pattern=[d[2] for d in done], error=[d[3] for d in done],
        )


def batch_errors(queries: DataFrame) -> DataFrame:
    """(query_id, query, error) of the queries that ``search_batch`` leaves out."""
    return compile_queries(queries).where(F.col("error").isNotNull()).select("query_id", "query", "error")


def with_rarest_gram(index: Index, compiled: DataFrame) -> DataFrame:
    """Each query with a gram that the fewest documents hold, and their number ``n``.

    A regex with alternatives has a row for each of them, as far as their grams differ. An alternative one of whose grams no
    document holds drops out. ``sets`` are the rarest grams of each alternative that has this gram as its rarest.
    """
    keep = [c for c in compiled.columns if c not in ("query_id", "options", "error")]
    wanted = compiled.where(F.col("error").isNull()).select("query_id", *keep, F.posexplode("options").alias("option", "grams"))
    wanted = wanted.withColumn("gram", F.explode("grams")).drop("grams")
    count = F.coalesce("n", F.lit(0))
    best = wanted.join(index.gram_counts(), "gram", "left").groupBy("query_id", "option").agg(
        F.min_by("gram", F.struct(count, "gram")).alias("gram"),
        F.min(count).alias("n"),
        F.slice(F.array_sort(F.collect_set(F.struct(count.alias("n"), "gram"))), 1, PREFILTER_GRAMS)["gram"].alias("grams"),
        *(F.any_value(c).alias(c) for c in keep),
    )
    sets = F.collect_set("grams").alias("sets")
    return best.where(F.col("n") > 0).groupBy("query_id", "gram").agg(sets, *(F.any_value(c).alias(c) for c in ("n", *keep)))


def search_batch(
    index: Index,
    queries: DataFrame,
    *,
    max_results: int | None = MAX_RESULTS,
    per_file: int | None = HITS_PER_FILE,
) -> DataFrame:
    """(query_id, file, line, text) of the hits of every query.

    How a query meets documents depends on numbers that are known before. Substrings that few documents can hold, and all
    regexes, go by pairs: a query meets those that hold its rarest gram. Many substrings that many documents can hold are
    searched for together, in one pass of an automaton over each text (``plans.needles``).
    """
    # The compiled queries are small, used several times and counted first: a table, made once.
    asked_at = fresh_folder(index.spark, "queries")
    kinds = F.when(F.col("regex") | F.contains("needle", F.lit("\n")), "pattern").otherwise("needle")
    with_rarest_gram(index, compile_queries(queries)).withColumn("kind", kinds).write.parquet(asked_at)
    asked = index.spark.read.parquet(asked_at)
    totals = {r["kind"]: r for r in asked.groupBy("kind").agg(
        F.count("*").alias("queries"), F.sum("n").alias("pairs"), F.max("max").alias("own"),
        F.sum(F.octet_length("query")).alias("bytes"), (F.count("*") > F.count_distinct("query_id")).alias("several"),
    ).collect()}
    asked = asked.drop("n").withColumnRenamed("max", "max_hits")
    parts = []
    plain = totals.get("needle")
    if plain and plain["queries"] >= NEEDLES_TOGETHER and plain["pairs"] > lookup_limit(index) and plain["bytes"] <= BROADCAST_BYTES:
        parts.append(_by_automaton(index, asked.where("kind = 'needle'").drop("kind"), per_file, plain["queries"]))
        asked = asked.where("kind = 'pattern'")
        totals.pop("needle")
    if totals:
        sums = {c: sum(t[c] or 0 for t in totals.values()) for c in ("queries", "pairs", "bytes")}
        several = any(t["several"] for t in totals.values())
        parts.append(_by_pairs(index, asked.drop("kind"), per_file, several, **sums))
        own = [t["own"] for t in totals.values()]
    else:
        own = []
    if not parts:
        return index.spark.createDataFrame([], "query_id bigint, file string, line int, text string")
    own = max((o for o in [*own, plain["own"] if plain else None] if o is not None), default=None)
    hits = index.live(reduce(DataFrame.unionByName, parts))
    return _capped(hits, max_results, own).select("query_id", "file", "line", "text")


HIT_COLUMNS = ("seg", "doc", "query_id", "max_hits", "n_grams", "file", "line", "text")


def _by_automaton(index: Index, asked: DataFrame, per_file: int | None, queries: int) -> DataFrame:
    """Hits of substrings by one pass over all texts, live or not. The needles' bytes were counted."""
    needles = ((r["query_id"], r["needle"], r["case_sensitive"]) for r in asked.select("query_id", "needle", "case_sensitive").toLocalIterator())
    docs = index.docs("path", "n_grams", "text", live=False)
    hits = needle_hits(docs, needles, per_file, "seg", "doc", "path", "n_grams").withColumnRenamed("path", "file")
    limits = asked.select("query_id", "max_hits")
    return hits.join(F.broadcast(limits) if queries <= BROADCAST_ROWS else limits, "query_id").select(*HIT_COLUMNS)


def _by_pairs(index: Index, asked: DataFrame, per_file: int | None, several: bool, queries: int, pairs: int, bytes: int) -> DataFrame:
    """Hits of queries that each meet the documents holding their rarest gram, or one of those (``several``), by equality.

    Few such pairs are fetched by number or broadcast to one scan of the text; many pairs of a
    bounded number of queries come from a scan that matches the documents' own grams against the
    queries' sets of grams; beyond that both sides are shuffled. Texts are shuffled only in the last case.
    """
    # Each row holds its query text, as a needle and as a pattern too.
    light = 3 * bytes <= BROADCAST_BYTES
    few_queries = queries <= BROADCAST_ROWS
    if few_queries and light and pairs > BROADCAST_ROWS:
        return _by_grams(index, asked, per_file)
    # Which documents a query meets is found by its gram alone; query texts come in when the pairs are known.
    meetings = _pairs(index, asked.select("query_id", "gram"), queries)
    meetings = meetings.select("seg", "doc", "query_id").distinct() if several else meetings
    if pairs <= lookup_limit(index):
        known = meetings.collect()  # a counted few, found once
        docs = index.docs_numbered(list({(k["seg"], k["doc"]): k for k in known}.values()), "path", "n_grams", "text")
        meetings = index.spark.createDataFrame(known, meetings.schema)
    else:
        docs = index.docs("path", "n_grams", "text", live=False)
    if pairs <= BROADCAST_ROWS:
        meetings = F.broadcast(meetings)
    texts = _once(asked) if several else asked.drop("gram", "sets")
    met = _prepared(docs.join(meetings, ["seg", "doc"])).join(F.broadcast(texts) if few_queries and light else texts, "query_id")
    return _verify(met, per_file)


def _by_grams(index: Index, asked: DataFrame, per_file: int | None) -> DataFrame:
    """Hits by one scan: a text's own grams tell which queries it can answer, and only with those does it meet.

    The queries were counted. No row is made for a gram of a text. A regex meets the lines that have its grams, others a whole text,
    which is lowered and split once.
    """
    small_batches(index.spark)
    sets: dict[bool, dict[int | None, list]] = {}
    for r in asked.select("query_id", "sets", "regex").toLocalIterator():
        sets.setdefault(r["regex"], {}).setdefault(r["query_id"], []).extend(r["sets"])
    texts, parts = F.broadcast(_once(asked)), []
    same = F.col("asked").eqNullSafe(F.col("query_id"))
    if True in sets:
        docs = index.docs("path", "n_grams", "text", live=False)
        found = docs.mapInArrow(meeting_lines(list(sets[True].items())), f"{_schema(docs, 'text')}, asked bigint, lines array<struct<line:int,text:string>>")
        hits = first_trimmed(F.filter("lines", lambda h: F.rlike(h["text"], F.col("pattern"))), per_file)
        met = found.join(texts, same).where(F.col("regex"))
        parts.append(met.select("seg", "doc", "query_id", "max_hits", "n_grams", F.col("path").alias("file"), F.inline(hits).alias("line", "text")))
    if False in sets:
        docs = index.docs("path", "n_grams", "text", "grams", live=False)
        found = docs.mapInArrow(meeting_queries(list(sets[False].items())), f"{_schema(docs, 'grams')}, asked array<bigint>")
        met = _prepared(found).withColumn("asked", F.explode("asked")).join(texts, same).where(~F.col("regex"))
        parts.append(_verify(met, per_file))
    return reduce(DataFrame.unionByName, parts)


def _schema(rows: DataFrame, without: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != without)


def _once(asked: DataFrame) -> DataFrame:
    """A row for each query, without its grams."""
    return asked.drop("gram", "sets").dropDuplicates(["query_id"])


def _capped(hits: DataFrame, max_results: int | None, own: int | None) -> DataFrame:
    """The first hits of each query: as many as its own ``max`` says, else ``max_results``.

    ``own`` is the largest of these, null without any. Queries without a limit are not ranked.
    """
    if max_results is None and own is None:
        return hits
    order = Window.partitionBy("query_id").orderBy("n_grams", "file", "line")
    free = hits.where("max_hits IS NULL") if max_results is None else None
    capped = hits.where("max_hits IS NOT NULL") if max_results is None else hits
    # The largest limit, as a literal, cuts each task's rows before they are shuffled.
    most = max(x for x in (max_results, own) if x is not None)
    ranked = capped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    ranked = ranked.where(F.col("rank") <= F.coalesce("max_hits", F.lit(max_results))).drop("rank")
    return ranked if free is None else free.unionByName(ranked)


SALTS = 16


def _pairs(index: Index, asked: DataFrame, n_queries: int) -> DataFrame:
    """Queries with the (seg, doc) that hold their gram.

    The grams of few queries become literals, which prune the postings. Too many queries to
    broadcast are salted: the lists of a common gram spread by block over several tasks, each of
    which gets a copy of the queries that ask for the gram.
    """
    if n_queries <= LOOKUP_ROWS:
        grams = sorted(r["gram"] for r in asked.select("gram").distinct().collect())
        met = index.postings(grams).join(F.broadcast(asked), "gram")
    elif n_queries <= BROADCAST_ROWS:
        met = index.postings().join(F.broadcast(asked), "gram")
    else:
        salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        lists = index.postings().withColumn("salt", F.pmod("block", F.lit(SALTS)).cast("int"))
        met = lists.join(salted, ["gram", "salt"]).drop("salt")
    return met.withColumn("doc", F.explode("docs")).drop("docs", "block", "gram")


def _prepared(rows: DataFrame) -> DataFrame:
    """Add the lowered text and the numbered lines, each lowered and without a carriage return at its end too."""
    lines = F.transform(
        lines_of("text"),
        lambda t, i: F.struct(
            (i + 1).cast("int").alias("line"), t.alias("text"), ascii_lower(t).alias("low"), without_return(t).alias("bare")
        ),
    )
    return rows.withColumn("low", ascii_lower("text")).withColumn("lines", lines)


def _verify(met: DataFrame, per_file: int | None) -> DataFrame:
    """Hits of (query, prepared text) rows, by the row's own needle or pattern."""
    text, query, pattern = F.col("text"), F.col("query"), F.col("pattern")

    def holds(plain: Column, low: Column) -> Column:
        return F.contains(F.when(F.col("case_sensitive"), plain).otherwise(low), F.col("needle"))

    breaks = F.length(query) - F.length(F.replace(query, F.lit("\n"), F.lit("")))
    # what ``lines_of(regex=True)`` gives, from the lines split before: an empty last one is none
    last = F.size("lines")
    regex_lines = F.filter("lines", lambda h: F.rlike(h["bare"], pattern) & ((h["line"] < last) | (h["text"] != "")))
    plain_lines = F.filter("lines", lambda h: holds(h["text"], h["low"]))
    found = (
        F.when(F.col("regex"), first_trimmed(regex_lines, per_file))
        .when(breaks > 0, spanning_lines(text, pattern, breaks, per_file))
        .otherwise(first_trimmed(plain_lines, per_file))
    )
    return met.where(F.col("regex") | holds(text, F.col("low"))).select(
        "seg", "doc", "query_id", "max_hits", "n_grams", F.col("path").alias("file"), F.inline(found).alias("line", "text")
    )
