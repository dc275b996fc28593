"""Queries on the driver's tables, each with the SQL that gives the same rows.

A query takes (spark, folder of the tables) and returns a DataFrame. The tables serve as corpora:
a document is a file ``source/doc_id`` below the root ``source``. The index over them is built once
per session and folder, in the shared folder of the session.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.functions.encodings import canonical_encoding, decode_text, is_binary
from gramlode.functions.gramplan import gram_tree
from gramlode.functions.ignore import parse_rules
from gramlode.functions.marks import first_column, highlight, match_ranges
from gramlode.functions.paths import base_name, dir_name, rel_path
from gramlode.functions.regex import extract_literals_col, java_regex
from gramlode.functions.text import (
    ascii_lower,
    distinct_ngrams,
    epoch_millis,
    hit_json,
    query_ngrams,
    query_ngrams_col,
    rfc3339,
    split_lines,
    trim_end,
)
from gramlode.operators import status as status_of
from gramlode.operators import sync as syncing
from gramlode.operators.candidates import candidates
from gramlode.operators.candidates import gram_document_frequency as live_frequency
from gramlode.operators.hits import NO_MATCHES, count_hits, filter_paths, format_hits, group_hits, json_array, json_messages, search_summary, write_json_array
from gramlode.operators.index import Index, build_index, compact, open_index
from gramlode.operators.status import build_totals, document_count, index_status
from gramlode.plans.batch import batch_errors, search_batch
from gramlode.plans.fresh import search_fresh
from gramlode.plans.search import search
from gramlode.session import configure, fresh_folder
from gramlode.sources.files import FileCorpus, apply_ignore, assign_root, drop_hidden, parse_root_specs, read_roots
from gramlode.sources.folder import Folder
from gramlode.sources.tables import TableCorpus
from gramlode.streaming.changes import (
    EVENTS_SCHEMA,
    debounce,
    debounce_stream,
    flush,
    follow,
    read_changes,
    relevant,
    with_flush,
)
from gramlode.streaming.roots import root_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir.rstrip("/"))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return run

    return register


# --------------------------------------------------------------------------- tables and indexes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path():
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))


def documents(spark: SparkSession, sf_dir: str) -> TableCorpus:
    df = table(spark, sf_dir, "documents")
    return TableCorpus(df, path=doc_path(), root="source", mtime="n_chars")


def pages(spark: SparkSession, sf_dir: str) -> TableCorpus:
    return TableCorpus(table(spark, sf_dir, "pages"), path="url", text="html")


def conversations(spark: SparkSession, sf_dir: str) -> TableCorpus:
    turns = table(spark, sf_dir, "conversations")
    path = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return TableCorpus(turns, path=path)


_BUILT: dict[tuple, Index] = {}


def index_of(spark: SparkSession, sf_dir: str, corpus: Callable) -> Index:
    """The index of a corpus, built at its first use in this session."""
    key = (spark.sparkContext.applicationId, sf_dir, corpus.__name__)
    if key not in _BUILT:
        source = corpus(spark, sf_dir)
        roots = [{"path": sf_dir, "encoding": "utf-8"}]
        _BUILT[key] = build_index(source.texts(), fresh_folder(spark, corpus.__name__), roots=roots)
    return _BUILT[key]


def doc_hits(spark: SparkSession, sf_dir: str, text: str, **options) -> DataFrame:
    return search(index_of(spark, sf_dir, documents), text, **{"max_results": None, "per_file": None, "ordered": False, **options}).hits


# --------------------------------------------------------------------------- SQL building blocks

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lo(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def gram_lo(x: str) -> str:
    return f"translate({x}, '{UPPER}Kſ', '{LOWER}ks')"


TRIMMED = r"regexp_replace(line_text, '[\s\p{Z}\x0B\x{85}]+$', '')"

LINES = """lines AS (
  SELECT source || '/' || doc_id AS file, unnest(string_split(text, chr(10))) AS line_text,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line
  FROM documents)"""

GRAMS = f"""chars AS (
  SELECT doc_id, unnest(a) AS c, generate_subscripts(a, 1) AS p
  FROM (SELECT doc_id, regexp_extract_all({gram_lo('text')}, '(?s).') AS a FROM documents)),
windows AS (
  SELECT doc_id, c || lead(c) OVER w AS two, c || lead(c) OVER w || lead(c, 2) OVER w AS three
  FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
grams AS (
  SELECT DISTINCT doc_id, two AS gram FROM windows WHERE two IS NOT NULL
  UNION ALL SELECT DISTINCT doc_id, three FROM windows WHERE three IS NOT NULL),
sizes AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_grams FROM grams GROUP BY doc_id)"""


def hits_sql(condition: str, cap: int | None = None) -> str:
    """All lines with a condition on ``line_text``, or the first ``cap`` per file."""
    first = "" if cap is None else f"QUALIFY row_number() OVER (PARTITION BY file ORDER BY line) <= {cap}"
    return f"""WITH {LINES}
SELECT file, line, {TRIMMED} AS text FROM lines WHERE {condition} {first}"""


def ci(needle: str) -> str:
    return f"contains({lo('line_text')}, '{needle}')"


# --------------------------------------------------------------------------- searches


@query(hits_sql(ci("tion")))
def search_substring_ci(spark, sf_dir):
    return doc_hits(spark, sf_dir, "Tion")


@query(hits_sql("contains(line_text, 'The')"))
def search_substring_cs(spark, sf_dir):
    return doc_hits(spark, sf_dir, "The", case_sensitive=True)


@query(hits_sql(ci("qu")))
def search_two_char(spark, sf_dir):
    return doc_hits(spark, sf_dir, "qu")


@query(f"SELECT 'q' AS query, CAST(0 AS BIGINT) AS n_hits UNION ALL SELECT 'qu', count(*) FROM ({hits_sql(ci('qu'))})")
def search_short_query(spark, sf_dir):
    """One character matches nothing, next to two that do."""
    counts = [doc_hits(spark, sf_dir, q).agg(F.lit(q).alias("query"), F.count("*").alias("n_hits")) for q in ("q", "qu")]
    return counts[0].unionByName(counts[1])


@query(hits_sql(ci("worthless | o")))
def search_rare(spark, sf_dir):
    """A query rare enough for its documents to be fetched by number."""
    return doc_hits(spark, sf_dir, "worthless | o")


@query(hits_sql(ci("zqxvzq")))
def search_no_hit(spark, sf_dir):
    return doc_hits(spark, sf_dir, "zqxvzq")


@query(hits_sql(ci("eñ")))
def search_non_ascii(spark, sf_dir):
    """Two characters, one beyond ASCII: only the ASCII one folds."""
    return doc_hits(spark, sf_dir, "Eñ")


@query(hits_sql("regexp_matches(line_text, 'th[a-e]+r.*tion', 'i')"))
def search_regex_ci(spark, sf_dir):
    return doc_hits(spark, sf_dir, "th[a-e]+r.*tion", regex=True)


@query(hits_sql("regexp_matches(line_text, '^The.+ing', 'c')"))
def search_regex_cs(spark, sf_dir):
    return doc_hits(spark, sf_dir, "^The.+ing", regex=True, case_sensitive=True)


@query(hits_sql("regexp_matches(line_text, 'worthless|[0-9]{3}-[0-9]{4}|click', 'i')"))
def search_regex_alternation(spark, sf_dir):
    """No literal is in every match: the prefilter must not lose any branch."""
    return doc_hits(spark, sf_dir, "worthless|[0-9]{3}-[0-9]{4}|click", regex=True)


@query(
    hits_sql("regexp_matches(line_text, 'worth(y|less)ness|worthless', 'i')").replace(
        "FROM lines WHERE",
        f"""FROM lines WHERE file IN (
    SELECT source || '/' || doc_id FROM documents
    WHERE contains({lo('text')}, 'wor') AND contains({lo('text')}, 'ort') AND contains({lo('text')}, 'rth')
      AND contains({lo('text')}, 'les') AND contains({lo('text')}, 'ess') AND contains({lo('text')}, 'nes')
      AND contains({lo('text')}, 'thl') AND contains({lo('text')}, 'hle')) AND""",
    )
)
def search_regex_compat(spark, sf_dir):
    """Every literal run counts as required, as the character-level extraction has it."""
    return doc_hits(spark, sf_dir, "worth(y|less)ness|worthless", regex=True, prefilter="compat")


@query(hits_sql("regexp_matches(line_text, 'worthless|inoran the', 'i')"))
def search_regex_either(spark, sf_dir):
    """Two literals, one or the other: the buckets of both are read, and nothing else."""
    return doc_hits(spark, sf_dir, "worthless|inoran the", regex=True)


@query(hits_sql("regexp_matches(line_text, '(worth|honor)(less|able)s?( [a-z]|[.])', 'i')"))
def search_regex_groups(spark, sf_dir):
    """Literals inside groups only."""
    return doc_hits(spark, sf_dir, "(worth|honor)(less|able)s?( [a-z]|[.])", regex=True)


@query(hits_sql("regexp_matches(line_text, 'wo[rn][tk]', 'i')"))
def search_regex_classes(spark, sf_dir):
    """A literal spelled out from small classes."""
    return doc_hits(spark, sf_dir, "wo[rn][tk]", regex=True)


# Patterns, and what their trees ask of a text: any of some sets of grams.
TREES = (
    ("worthless|inoran the", (("wor", "ort", "rth", "thl", "hle", "les", "ess"), ("ino", "nor", "ora", "ran", "an ", "n t", " th", "the"))),
    ("(un|une) [eé]n", (("un ", "n e", " en"), ("un ", "n é", " én"), ("une", "ne ", "e e", " en"), ("une", "ne ", "e é", " én"))),
    ("wh?orth", (("wor", "ort", "rth"), ("who", "hor", "ort", "rth"))),
    (r"\b(tion|keit)+[0-9]?[.]", (("tio", "ion"), ("kei", "eit"))),
)


@query(" UNION ALL ".join(
    f"SELECT '{pattern}' AS pattern, source || '/' || doc_id AS path FROM documents WHERE "
    + " OR ".join("(" + " AND ".join(f"contains({gram_lo('text')}, '{g}')" for g in grams) + ")" for grams in options)
    for pattern, options in TREES
))
def regex_candidates(spark, sf_dir):
    """The documents that satisfy the tree of grams of each pattern, before any line is checked."""
    index = index_of(spark, sf_dir, documents)
    found = [candidates(index, gram_tree(p, case_sensitive="é" in p)).select(F.lit(p).alias("pattern"), "path") for p, _ in TREES]
    return reduce(DataFrame.unionByName, found)


@query(hits_sql("regexp_matches(line_text, '[0-9]{3}')"))
def search_regex_scan(spark, sf_dir):
    """No literal at all: every text is verified, on request."""
    return doc_hits(spark, sf_dir, "[0-9]{3}", regex=True, allow_scan=True)


@query(f"""WITH {LINES}, {GRAMS}
SELECT file, line, {TRIMMED} AS text
FROM lines JOIN documents d ON file = d.source || '/' || d.doc_id JOIN sizes USING (doc_id)
WHERE {ci('tion')}
ORDER BY n_grams, file, line LIMIT 300""")
def search_max(spark, sf_dir):
    """The first 300 hits in result order."""
    return doc_hits(spark, sf_dir, "tion", max_results=300)


@query(hits_sql(ci("the"), cap=3))
def per_file_cap(spark, sf_dir):
    return doc_hits(spark, sf_dir, "the", per_file=3)


@query(f"""WITH pieces AS (
  SELECT source || '/' || doc_id AS file, text, unnest(p) AS piece, generate_subscripts(p, 1) AS k, len(p) AS n
  FROM (SELECT *, string_split({lo('text')}, '.' || chr(10) || 'th') AS p FROM documents)),
starts AS (
  SELECT file, text, k, n, CAST(k + sum(length(piece) - length(replace(piece, chr(10), '')))
    OVER (PARTITION BY file ORDER BY k) AS INTEGER) AS line FROM pieces),
found AS (SELECT DISTINCT file, line, string_split(text, chr(10))[line] AS line_text FROM starts WHERE k < n)
SELECT file, line, {TRIMMED} AS text FROM found""")
def multiline_needle(spark, sf_dir):
    return doc_hits(spark, sf_dir, ".\nTh")


@query(f"""WITH {GRAMS}, wanted AS (
  SELECT doc_id, n_grams FROM sizes JOIN documents USING (doc_id)
  WHERE contains({lo('text')}, 'tio') AND contains({lo('text')}, 'ion')
  ORDER BY n_grams, source || '/' || doc_id LIMIT 40), {LINES}
SELECT file, line, {TRIMMED} AS text
FROM lines JOIN documents d ON file = d.source || '/' || d.doc_id JOIN wanted USING (doc_id)
WHERE {ci('tion')}""")
def search_candidate_limit(spark, sf_dir):
    """Only the best 40 candidates are verified, as asked."""
    return doc_hits(spark, sf_dir, "tion", candidate_limit=40)


@query(hits_sql(ci("tion")))
def search_reread(spark, sf_dir):
    """Candidates verified against the corpus instead of the stored text."""
    return doc_hits(spark, sf_dir, "tion", corpus=documents(spark, sf_dir))


@query(hits_sql(ci('href="/the')).replace("source || '/' || doc_id AS file", "url AS file")
       .replace("FROM documents", "FROM pages").replace("(text, chr(10))", "(html, chr(10))"))
def search_pages(spark, sf_dir):
    return search(index_of(spark, sf_dir, pages), 'href="/the', max_results=None, per_file=None, ordered=False).hits


@query(hits_sql(ci("the")).replace("source || '/' || doc_id AS file", "conv_id || '/' || turn AS file")
       .replace("FROM documents", "FROM conversations"))
def search_conversations(spark, sf_dir):
    return search(index_of(spark, sf_dir, conversations), "the", max_results=None, per_file=None, ordered=False).hits


@query(f"""WITH {LINES}, lowered AS MATERIALIZED (SELECT *, {lo('line_text')} AS low FROM lines),
asked AS (
  SELECT item_id * 100000 + generate_subscripts(w, 1) AS query_id, unnest(w) AS query
  FROM (SELECT item_id, string_split_regex(text, '\\s+') AS w FROM benchmark)),
needles AS MATERIALIZED (SELECT DISTINCT {lo('query')} AS needle FROM asked WHERE length(query) >= 2),
met AS (SELECT needle, file, line, line_text FROM needles JOIN lowered ON contains(low, needle))
SELECT query_id, CAST(count(*) AS BIGINT) AS n_hits, CAST(count(DISTINCT file) AS BIGINT) AS n_files,
       CAST(sum(line) AS BIGINT) AS line_sum, CAST(sum(length({TRIMMED})) AS BIGINT) AS n_chars
FROM asked JOIN met ON needle = {lo('query')} GROUP BY query_id""")
def search_batch_words(spark, sf_dir):
    """Every word of the benchmark items, looked up in all documents at once; the hits in numbers."""
    items = table(spark, sf_dir, "benchmark")
    words = items.select("item_id", F.posexplode(F.split("text", "\\s+", -1)).alias("pos", "query"))
    asked = words.select((F.col("item_id") * 100000 + F.col("pos") + 1).alias("asked_id"), ascii_lower("query").alias("query"))
    asked = asked.where("asked_id IS NOT NULL").dropDuplicates(["asked_id"])
    # A word that is asked for many times is searched for once.
    queries = asked.groupBy("query").agg(F.min("asked_id").alias("query_id"))
    hits = search_batch(index_of(spark, sf_dir, documents), queries, max_results=None, per_file=None)
    per_file = hits.groupBy("query_id", "file").agg(
        F.count("*").alias("n"), F.sum("line").alias("lines"), F.sum(F.length("text")).alias("chars")
    )
    numbers = per_file.groupBy("query_id").agg(
        F.sum("n").alias("n_hits"), F.count("*").alias("n_files"),
        F.sum("lines").alias("line_sum"), F.sum("chars").alias("n_chars"),
    )
    same = asked.join(queries, "query").select("query_id", "asked_id")
    return numbers.join(same, "query_id").select(F.col("asked_id").alias("query_id"), "n_hits", "n_files", "line_sum", "n_chars")


@query(f"""WITH asked AS (SELECT item_id AS query_id, text AS query FROM benchmark),
pieces AS (
  SELECT query_id, query, source || '/' || doc_id AS file, text, unnest(p) AS piece,
         generate_subscripts(p, 1) AS k, len(p) AS n
  FROM (SELECT query_id, query, source, doc_id, text, string_split({lo('text')}, {lo('query')}) AS p
        FROM asked JOIN documents ON contains({lo('text')}, {lo('query')}))),
starts AS (
  SELECT query_id, file, text, k, n, CAST(1
    + sum(length(piece) - length(replace(piece, chr(10), ''))) OVER w
    + (k - 1) * (length(query) - length(replace(query, chr(10), ''))) AS INTEGER) AS line
  FROM pieces WINDOW w AS (PARTITION BY query_id, file ORDER BY k)),
found AS (
  SELECT DISTINCT query_id, file, line, string_split(text, chr(10))[line] AS line_text FROM starts WHERE k < n)
SELECT query_id, file, line, {TRIMMED} AS text FROM found""")
def search_batch_passages(spark, sf_dir):
    """Every benchmark item as a whole, line breaks included, looked up in all documents."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search_batch(index_of(spark, sf_dir, documents), queries, max_results=None, per_file=None)


# --------------------------------------------------------------------------- grams and candidates


@query(f"""WITH {GRAMS}
SELECT d.doc_id, CAST(count(gram) AS BIGINT) AS n_grams,
       CAST(coalesce(sum(CASE WHEN length(gram) = 2 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_bigrams,
       CAST(coalesce(sum(strlen(gram)), 0) AS BIGINT) AS n_bytes
FROM documents d LEFT JOIN grams USING (doc_id) GROUP BY d.doc_id""")
def doc_ngrams_stats(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", distinct_ngrams("text").alias("grams"))
    sizes = F.transform("grams", lambda g: F.octet_length(g))
    return df.select(
        "doc_id",
        F.size("grams").cast("bigint").alias("n_grams"),
        F.size(F.filter("grams", lambda g: F.length(g) == 2)).cast("bigint").alias("n_bigrams"),
        F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n_bytes"),
    )


@query(f"WITH {GRAMS} SELECT gram, CAST(count(*) AS BIGINT) AS n FROM grams GROUP BY gram")
def gram_document_frequency(spark, sf_dir):
    """Documents per gram, for every gram of the index."""
    return index_of(spark, sf_dir, documents).gram_counts().select("gram", F.col("n").cast("bigint").alias("n"))


PAIRS_OF_TASK = 1_000_000    # pairs of document and gram that a task sorts: more pairs are more tasks, not larger ones


@query(f"WITH {GRAMS} SELECT source || '/' || doc_id AS file, gram FROM grams JOIN documents USING (doc_id)")
def postings_table(spark, sf_dir):
    """The whole inverted table: every file with every gram it holds."""
    index = index_of(spark, sf_dir, documents)
    tasks = max(1, -(-sum(s["postings"] for s in index.commit.segments) // PAIRS_OF_TASK))
    pairs, docs = (df.repartition(tasks, "seg", "doc") for df in (index.pairs(), index.docs("path")))
    return pairs.join(docs.hint("merge"), ["seg", "doc"]).select(F.col("path").alias("file"), "gram")


def candidates_sql(tail: str = "") -> str:
    return f"""WITH {GRAMS}
SELECT source || '/' || doc_id AS file, source AS root, 'utf-8' AS enc, n_chars AS mtime,
       CAST(strlen(text) AS BIGINT) AS size, n_grams
FROM documents JOIN sizes USING (doc_id)
WHERE doc_id IN (SELECT doc_id FROM grams WHERE gram IN ('tio', 'ion', 'on ') GROUP BY doc_id HAVING count(*) = 3)
{tail}"""


def _candidates(spark, sf_dir, limit=None):
    found = candidates(index_of(spark, sf_dir, documents), query_ngrams("tion "), limit)
    return found.select(F.col("path").alias("file"), "root", "enc", "mtime", "size", "n_grams")


@query(candidates_sql())
def candidate_docs(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query(candidates_sql("ORDER BY n_grams, file LIMIT 100"))
def candidate_topk(spark, sf_dir):
    return _candidates(spark, sf_dir, 100)


# --------------------------------------------------------------------------- column functions


@query(f"SELECT doc_id, md5({lo('text')}) AS lowered FROM documents")
def fold_ascii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(ascii_lower("text").cast("binary")).alias("lowered"))


@query(f"WITH {LINES} SELECT file, line, line_text AS text FROM lines")
def text_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(doc_path().alias("file"), "text")
    return split_lines(rows)


@query("""WITH lines AS (
  SELECT page_id, unnest(l) AS text, CAST(generate_subscripts(l, 1) AS INTEGER) AS line, len(l) AS n
  FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages))
SELECT page_id, line, regexp_replace(text, '\\r$', '') AS text FROM lines WHERE NOT (line = n AND text = '')""")
def text_lines_regex(spark, sf_dir):
    return split_lines(table(spark, sf_dir, "pages").select("page_id", "html"), "html", regex=True)


@query(f"WITH {LINES} SELECT file, line, {TRIMMED} AS text FROM lines")
def trimmed_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(doc_path().alias("file"), "text")
    return split_lines(rows).withColumn("text", trim_end("text"))


@query(f"""WITH words AS (
  SELECT item_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word
  FROM (SELECT item_id, string_split_regex(text, '\\s+') AS w FROM benchmark)),
t AS (SELECT item_id, pos, {gram_lo('word')} AS word FROM words)
SELECT DISTINCT item_id, pos, gram FROM (
  SELECT item_id, pos, word AS gram FROM t WHERE length(word) = 2
  UNION ALL SELECT item_id, pos, unnest([word[i:i + 2] for i in range(1, length(word) - 1)]) FROM t
  WHERE length(word) > 2)""")
def needle_grams(spark, sf_dir):
    """The grams that each benchmark word requires."""
    items = table(spark, sf_dir, "benchmark")
    words = items.select("item_id", F.posexplode(F.split("text", "\\s+", -1)).alias("pos", "word"))
    return words.select(
        "item_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.explode(query_ngrams_col("word")).alias("gram")
    )


@query(f"""WITH runs AS (SELECT doc_id, regexp_extract_all({lo('text')}, '([a-z0-9_]|[^\\x00-\\x7F]){{2,}}') AS r FROM documents)
SELECT doc_id, CAST(len(r) AS BIGINT) AS n_runs, md5(array_to_string(r, '|')) AS runs FROM runs""")
def pattern_literals(spark, sf_dir):
    """Literal runs of every text, read as a pattern."""
    df = table(spark, sf_dir, "documents").select("doc_id", extract_literals_col("text").alias("r"))
    joined = F.array_join("r", "|").cast("binary")
    return df.select("doc_id", F.size("r").cast("bigint").alias("n_runs"), F.md5(joined).alias("runs"))


ALIAS = "CASE lang WHEN 'en' THEN 'UTF8' WHEN 'fr' THEN 'SJIS' WHEN 'de' THEN 'EUC_JP' ELSE 'Cp932' END"
CANONICAL = "CASE lang WHEN 'en' THEN 'utf-8' WHEN 'de' THEN 'euc-jp' ELSE 'shift_jis' END"


@query(f"SELECT doc_id, {ALIAS} AS alias, {CANONICAL} AS encoding FROM documents")
def encoding_alias(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.expr(ALIAS).alias("alias"))
    return df.withColumn("encoding", canonical_encoding("alias"))


@query(f"""SELECT CASE WHEN lang = 'en' THEN source || '@' ELSE 'a@b/' || source END AS path,
  CASE WHEN lang = 'en' THEN 'utf-8' ELSE {CANONICAL} END AS encoding FROM documents""")
def root_specs(spark, sf_dir):
    """Specs with an encoding after the last @, or with nothing after it."""
    spec = f"CASE WHEN lang = 'en' THEN source || '@' ELSE 'a@b/' || source || '@' || {ALIAS} END AS spec"
    return parse_root_specs(table(spark, sf_dir, "documents").selectExpr(spec))


@query("""WITH roots AS (SELECT DISTINCT source AS path, lang AS encoding, 1 AS seq FROM documents
  WHERE lang = (SELECT max(lang) FROM documents)
  UNION ALL SELECT DISTINCT source || '/' || lang, 'deep', 2 FROM documents WHERE lang <> 'en'
  UNION ALL SELECT DISTINCT source, 'first', 0 FROM documents),
files AS (SELECT source || '/' || lang || '/' || doc_id AS path FROM documents)
SELECT f.path, arg_max(r.path, seq) AS root, arg_max(encoding, seq) AS enc
FROM files f JOIN roots r ON starts_with(f.path, r.path || '/') GROUP BY f.path""")
def root_assign(spark, sf_dir):
    """Files below several nested roots; the last one that covers a file counts."""
    docs = table(spark, sf_dir, "documents")
    top = docs.agg(F.max("lang").alias("lang"))
    roots = (
        docs.join(top, "lang").select(F.col("source").alias("path"), F.col("lang").alias("encoding"), F.lit(1).alias("seq"))
        .union(docs.where("lang <> 'en'").select(F.expr("source || '/' || lang"), F.lit("deep"), F.lit(2)))
        .union(docs.select("source", F.lit("first"), F.lit(0)))
        .distinct()
    )
    return assign_root(docs.select(F.expr("source || '/' || lang || '/' || doc_id").alias("path")), roots)


@query("""SELECT doc_id, md5(text) AS decoded, 'x' || chr(65533) || chr(65533) || md5(text) AS repaired FROM documents""")
def decoded_texts(spark, sf_dir):
    """Texts encoded by a charset that can hold them, decoded again; and with two bad bytes in front."""
    df = table(spark, sf_dir, "documents")
    ascii_only = F.octet_length("text") == F.length("text")
    enc = F.when(ascii_only, canonical_encoding(F.expr(ALIAS))).otherwise("utf-8")
    bad = F.concat(F.lit(b"x\xff\xfe"), F.encode("text", "UTF-8"))
    repaired = decode_text(bad, F.lit("utf-8"))
    return df.select(
        "doc_id",
        F.md5(decode_text(F.encode("text", "UTF-8"), enc).cast("binary")).alias("decoded"),
        F.concat(F.substring(repaired, 1, 3), F.md5(F.substr(repaired, F.lit(4)).cast("binary"))).alias("repaired"),
    )


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events""")
def rfc3339_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", rfc3339(F.col("ts").cast("timestamp")).alias("at"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE strlen(text) <= 2000")
def size_filter(spark, sf_dir):
    """Texts up to a size cap."""
    df = table(spark, sf_dir, "documents")
    corpus = TableCorpus(df, path="doc_id", max_bytes=2000)
    return corpus.indexable(corpus.listing()).select(F.col("path").cast("bigint").alias("doc_id"), "size")


# --------------------------------------------------------------------------- paths


def page_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, 'example[.]com/[^/]*/[^/]*[.]html', 'i')")
def path_include(spark, sf_dir):
    return filter_paths(page_paths(spark, sf_dir), "EXAMPLE.com/*/*.html", path="url")


@query("SELECT page_id, url FROM pages WHERE NOT contains(lower(url), 'example.net')")
def path_exclude(spark, sf_dir):
    return filter_paths(page_paths(spark, sf_dir), exclude=" Example.NET ", path="url")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '//m[.].*en/[^/][^/]', 'i') "
       "AND NOT regexp_matches(url, '[^/]*utm_[^/]*', 'i')")
def path_globs(spark, sf_dir):
    return filter_paths(page_paths(spark, sf_dir), "//m.**/en/??", "*utm_*", path="url")


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https:/') THEN substr(url, 8) ELSE url END AS rel,
  regexp_extract(url, '[^/]*$') AS base, regexp_replace(url, '/[^/]*$', '') AS folder FROM pages""")
def path_parts(spark, sf_dir):
    return page_paths(spark, sf_dir).select(
        "page_id", rel_path("url", F.lit("https:")).alias("rel"), base_name("url").alias("base"), dir_name("url").alias("folder")
    )


# --------------------------------------------------------------------------- hits


@query(f"SELECT file, CAST(count(*) AS BIGINT) AS n_hits, CAST(sum(line) AS BIGINT) AS line_sum, "
       f"min(line) AS first_line FROM ({hits_sql(ci('tion'))}) GROUP BY file")
def hits_by_file(spark, sf_dir):
    """Hits grouped by file, rows in line order."""
    grouped = group_hits(doc_hits(spark, sf_dir, "tion"))
    total = F.aggregate("rows", F.lit(0).cast("bigint"), lambda a, r: a + r["line"])
    return grouped.select("file", "n_hits", total.alias("line_sum"), F.get("rows", F.lit(0))["line"].alias("first_line"))


@query(f"SELECT file, CAST(count(*) AS BIGINT) AS n_hits FROM ({hits_sql(ci('tion'))}) GROUP BY file")
def hit_counts(spark, sf_dir):
    return count_hits(doc_hits(spark, sf_dir, "tion"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT file) AS BIGINT) AS files, "
       f"false AS candidates_truncated FROM ({hits_sql(ci('the'))})")
def hit_summary(spark, sf_dir):
    return search_summary(doc_hits(spark, sf_dir, "the"))


@query(f"SELECT file || ':' || line || ': ' || text AS value FROM ({hits_sql(ci('worth'))})")
def hit_text_lines(spark, sf_dir):
    return format_hits(doc_hits(spark, sf_dir, "worth"))


@query(f"""SELECT '{{"file":"' || file || '","line":' || line || ',"text":' || to_json(text) || '}}' AS value
FROM ({hits_sql(ci('worth'))})""")
def hit_json_lines(spark, sf_dir):
    return doc_hits(spark, sf_dir, "worth").select(hit_json().alias("value"))


@query(f"SELECT file, line, CAST(strpos(lower(text), 'tion') - 1 AS INTEGER) AS first_at FROM ({hits_sql(ci('tion'))})")
def first_columns(spark, sf_dir):
    return doc_hits(spark, sf_dir, "tion").select("file", "line", first_column("text", "TION").alias("first_at"))


@query(f"""WITH h AS ({hits_sql(ci('tion'))}), cut AS (
  SELECT file, line, unnest(p) AS piece, generate_subscripts(p, 1) AS k, len(p) AS n
  FROM (SELECT *, string_split(lower(text), 'tion') AS p FROM h)),
spans AS (SELECT file, line, k, n, CAST(sum(length(piece)) OVER w + 4 * (k - 1) AS INTEGER) AS start_at
  FROM cut WINDOW w AS (PARTITION BY file, line ORDER BY k))
SELECT file, line, start_at, start_at + 4 AS end_at FROM spans WHERE k < n""")
def match_spans(spark, sf_dir):
    hits = doc_hits(spark, sf_dir, "tion")
    return hits.select("file", "line", F.inline(match_ranges("text", "Tion", limit=None)).alias("start_at", "end_at"))


@query(f"""WITH h AS ({hits_sql("regexp_matches(line_text, 'worth[a-z]+', 'i')")})
SELECT file, line, CAST(len(regexp_extract_all(text, 'worth[a-z]+', 0, 'i')) AS INTEGER) AS n_spans,
       CAST(length(array_to_string(regexp_extract_all(text, 'worth[a-z]+', 0, 'i'), '')) AS INTEGER) AS marked FROM h""")
def match_spans_regex(spark, sf_dir):
    hits = doc_hits(spark, sf_dir, "worth[a-z]+", regex=True)
    hits = hits.withColumn("spans", match_ranges("text", "worth[a-z]+", regex=True, limit=None))
    marked = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return hits.select("file", "line", F.size("spans").alias("n_spans"), marked.alias("marked"))


ESCAPED = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""SELECT file, line, regexp_replace({ESCAPED}, '(href=&quot;/the)', '<span class="hl">\\1</span>', 'gi') AS html
FROM ({ORACLES['search_pages']})""")
def highlighted(spark, sf_dir):
    """Hit lines as HTML with the matches marked."""
    hits = search_pages(spark, sf_dir)
    return hits.select("file", "line", highlight("text", 'href="/the', limit=None).alias("html"))


# --------------------------------------------------------------------------- keeping current

OLD = """old AS (
  SELECT source || '/' || doc_id AS path, n_chars AS mtime, CAST(strlen(text) AS BIGINT) AS size
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""
NEW = """new AS (
  SELECT source || '/' || doc_id AS path,
         n_chars + CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS mtime,
         CAST(strlen(text) AS BIGINT) AS size
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))"""


def before(spark, sf_dir) -> TableCorpus:
    """An earlier state of the documents: those labelled toxic had not come yet."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").join(labels.where("toxic = 1"), "doc_id", "left_anti")
    return TableCorpus(docs, path=doc_path(), root="source", mtime="n_chars")


def after(spark, sf_dir) -> TableCorpus:
    """A later state: low quality is gone, documents of good quality were touched."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    docs = docs.where(F.coalesce("quality", F.lit(-1)) != 0)
    touched = F.col("n_chars") + F.when(F.col("quality") == 1, 1).otherwise(0)
    return TableCorpus(docs, path=doc_path(), root="source", mtime=touched)


DIFF = f"""WITH {OLD}, {NEW}, diff AS (
  SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'remove' ELSE 'update' END AS action
  FROM old o FULL OUTER JOIN new n ON o.path = n.path
  WHERE o.path IS NULL OR n.path IS NULL OR o.mtime <> n.mtime)"""


def _diff(spark, sf_dir):
    return syncing.sync_diff(after(spark, sf_dir).listing(), before(spark, sf_dir).listing())


@query(f"{DIFF} SELECT path, action FROM diff")
def sync_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query(f"{DIFF} SELECT CAST(count(*) FILTER (action = 'update') AS BIGINT) AS updated, "
       "CAST(count(*) FILTER (action = 'remove') AS BIGINT) AS removed FROM diff")
def sync_stats(spark, sf_dir):
    return syncing.sync_stats(_diff(spark, sf_dir))


@query(f"WITH {OLD}, {NEW} SELECT n.path FROM new n LEFT JOIN old o USING (path) "
       "WHERE o.path IS NULL OR o.mtime <> n.mtime")
def changed_files(spark, sf_dir):
    return syncing.changed_files(after(spark, sf_dir).listing(), before(spark, sf_dir).listing()).select("path")


@query(f"WITH {OLD}, {NEW} SELECT path FROM old WHERE path NOT IN (SELECT path FROM new)")
def deleted_files(spark, sf_dir):
    return syncing.deleted_files(after(spark, sf_dir).listing(), before(spark, sf_dir).listing())


@query(f"WITH {NEW} SELECT path, mtime, size FROM new")
def upsert_index(spark, sf_dir):
    old, new = before(spark, sf_dir).listing(), after(spark, sf_dir).listing()
    merged = syncing.upsert(old, syncing.changed_files(new, old), syncing.deleted_files(new, old))
    return merged.select("path", "mtime", "size")


def _synced(spark, sf_dir) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir, "synced")
    if key not in _BUILT:
        index = build_index(before(spark, sf_dir).texts(), fresh_folder(spark, "synced"))
        _BUILT[key], _ = syncing.sync(index, after(spark, sf_dir))
    return _BUILT[key]


AFTER_SYNC = f"""WITH {NEW}, {GRAMS}
SELECT path, mtime, size, n_grams FROM new
JOIN documents d ON path = d.source || '/' || d.doc_id JOIN sizes USING (doc_id)"""


@query(AFTER_SYNC)
def sync_index(spark, sf_dir):
    """An index built on the earlier state and synced to the later one."""
    return _synced(spark, sf_dir).files().select("path", "mtime", "size", "n_grams")


@query(AFTER_SYNC)
def compact_index(spark, sf_dir):
    """The same index folded into one segment."""
    key = (spark.sparkContext.applicationId, sf_dir, "compacted")
    if key not in _BUILT:
        _BUILT[key] = compact(_synced(spark, sf_dir))
    return _BUILT[key].files().select("path", "mtime", "size", "n_grams")


@query(hits_sql(ci("tion") + " AND file NOT IN (SELECT source || '/' || doc_id FROM documents "
                "JOIN labels USING (doc_id) WHERE quality = 0)"))
def search_synced(spark, sf_dir):
    """A search across segments with replaced and removed documents."""
    return search(_synced(spark, sf_dir), "tion", max_results=None, per_file=None, ordered=False).hits


@query("""SELECT source || '/' || doc_id AS path, n_chars AS mtime FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
   OR doc_id IN (SELECT user_id FROM events WHERE event_type IN ('click', 'view', 'purchase'))""")
def apply_change_batch(spark, sf_dir):
    """Change events (the user as document number) applied to an index of the earlier state."""
    key = (spark.sparkContext.applicationId, sf_dir, "changed")
    if key not in _BUILT:
        index = build_index(before(spark, sf_dir).texts(), fresh_folder(spark, "changed"))
        touched = change_events(spark, sf_dir).where(F.col("kind").isin("create", "modify", "remove"))
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), doc_path().alias("_p"))
        paths = touched.join(docs, "path").select(F.col("_p").alias("path"))
        _BUILT[key], _ = syncing.apply_changes(index, paths, documents(spark, sf_dir), "batch-0")
    return _BUILT[key].files().select("path", "mtime")


# --------------------------------------------------------------------------- status


@query("SELECT true AS built, CAST(count(*) AS BIGINT) AS file_count, true AS has_size, true AS has_build FROM documents")
def status(spark, sf_dir):
    row = index_status(spark, index_of(spark, sf_dir, documents).path)
    return row.select(
        "built", "file_count", (F.col("size_bytes") > 0).alias("has_size"), F.col("last_build").isNotNull().alias("has_build")
    )


@query("SELECT CAST(count(*) AS BIGINT) AS file_count FROM documents")
def document_total(spark, sf_dir):
    return document_count(index_of(spark, sf_dir, documents))


@query("SELECT source AS root, CAST(count(*) AS BIGINT) AS n_files FROM documents GROUP BY source")
def files_per_root(spark, sf_dir):
    return build_totals(index_of(spark, sf_dir, documents))


# --------------------------------------------------------------------------- change events

KIND = """CASE event_type WHEN 'click' THEN 'create' WHEN 'view' THEN 'modify' WHEN 'purchase' THEN 'remove'
  ELSE 'access' END"""


def change_events(spark, sf_dir) -> DataFrame:
    """The events as a change log of one busy root, the user as path."""
    return table(spark, sf_dir, "events").select(
        F.lit("all").alias("root"), F.col("user_id").cast("string").alias("path"),
        F.expr(KIND).alias("kind"), F.col("ts").cast("timestamp").alias("ts"),
    )


RUNS = """WITH log AS (
  SELECT {key} CAST(user_id AS VARCHAR) AS path, ts FROM events WHERE event_type IN ('click', 'view', 'purchase')),
marked AS (
  SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS opens
  FROM log WINDOW w AS (PARTITION BY {part} ORDER BY ts)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY {part} ORDER BY ts) AS run FROM marked),
spans AS (SELECT *, min(ts) OVER (PARTITION BY {part}, run) AS start, max(ts) OVER (PARTITION BY {part}, run) AS stop FROM runs)"""


@query(RUNS.format(key="'all' AS root,", part="root") + """
SELECT root, epoch_us(start) AS start_us, path, CAST(count(*) AS BIGINT) AS n_events FROM spans GROUP BY ALL""")
def debounce_batches(spark, sf_dir):
    """The distinct paths of each run of events with pauses of at most five minutes."""
    runs = debounce(change_events(spark, sf_dir), "5 minutes")
    return runs.select("root", F.unix_micros("start").alias("start_us"), "path", "n_events")


@query(RUNS.format(key="", part="path") + """
SELECT path, epoch_us(start) AS start_us, CAST(count(*) AS BIGINT) AS n_events FROM spans GROUP BY ALL""")
def debounce_streamed(spark, sf_dir):
    """The same change log as a stream: each path once it has been quiet for five minutes, at the end all."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = stream.select(
        F.lit("all").alias("root"), F.col("user_id").cast("string").alias("path"),
        F.expr(KIND).alias("kind"), F.col("ts").cast("timestamp").alias("ts"),
    )
    out, mark, marks = (fresh_folder(spark, n) for n in ("stream", "stream-mark", "stream-flush"))
    spark.createDataFrame([], EVENTS_SCHEMA).write.parquet(marks)
    runs = debounce_stream(with_flush(events, marks), "5 minutes")
    for last in (False, True):
        if last:
            flush(spark, marks)
        sink = runs.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True)
        sink.outputMode("append").start(out).awaitTermination()
    return spark.read.parquet(out).select("path", F.unix_micros("start").alias("start_us"), "n_events")


@query(RUNS.format(key="CAST(user_id % 7 AS VARCHAR) AS root,", part="root") + """
SELECT root, epoch_us(start) AS start_us, path, CAST(count(*) AS BIGINT) AS n_events FROM spans GROUP BY ALL""")
def debounce_roots_streamed(spark, sf_dir):
    """The change log of seven roots as a stream: a root's distinct paths come out together once the root was quiet for five minutes."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = stream.select(
        (F.col("user_id") % 7).cast("string").alias("root"), F.col("user_id").cast("string").alias("path"),
        F.expr(KIND).alias("kind"), F.col("ts").cast("timestamp").alias("ts"),
    )
    out, mark, marks = (fresh_folder(spark, n) for n in ("stream", "stream-mark", "stream-flush"))
    spark.createDataFrame([], EVENTS_SCHEMA).write.parquet(marks)
    flush(spark, marks)
    sink = root_batches(with_flush(events, marks), "5 minutes").writeStream.format("parquet")
    sink.option("checkpointLocation", mark).trigger(availableNow=True).outputMode("append").start(out).awaitTermination()
    return spark.read.parquet(out).select("root", F.unix_micros("start").alias("start_us"), "path", "n_events")


@query("""WITH touched AS (
  SELECT doc_id FROM documents WHERE doc_id IN (SELECT user_id FROM events WHERE event_type IN ('click', 'view', 'purchase')))
SELECT CAST(1 + count(DISTINCT doc_id % 3) AS BIGINT) AS version, (SELECT CAST(count(*) AS BIGINT) FROM documents) AS files,
  CAST(count(*) AS BIGINT) AS hits FROM touched""")
def follow_changes(spark, sf_dir):
    """Three batches of change events applied to an index, a commit each; going on where nothing is new commits nothing."""
    docs = table(spark, sf_dir, "documents")
    index = build_index(documents(spark, sf_dir).texts(), fresh_folder(spark, "followed"))
    users = change_events(spark, sf_dir).select(F.col("path").cast("bigint").alias("user_id"), "kind").distinct()
    mark, landing = fresh_folder(spark, "follow-mark"), fresh_folder(spark, "follow-events")
    events = relevant(users).join(docs.select(F.col("doc_id").alias("user_id"), doc_path().alias("path"), "source"), "user_id")
    events = events.select(F.col("source").alias("root"), "path", "kind", F.current_timestamp().alias("ts"), (F.col("user_id") % 3).alias("turn"))
    touched = events.select(F.split_part("path", F.lit("/"), F.lit(-1)).cast("bigint").alias("doc_id")).distinct().withColumn("hit", F.lit(True))
    changed = docs.join(touched, "doc_id", "left").withColumn("text", F.concat("text", F.when(F.col("hit"), F.lit("\nzqxfollowed")).otherwise(F.lit("")))).drop("hit")
    corpus = TableCorpus(changed, path=doc_path(), root="source", mtime="n_chars")
    for turn in (0, 1, 2, None):
        if turn is not None:
            events.where(F.col("turn") == turn).drop("turn").coalesce(1).write.mode("append").parquet(landing)
        follow(read_changes(spark, landing), index.path, corpus, mark, trigger={"availableNow": True}).awaitTermination()
    now = open_index(spark, index.path)
    hits = search(now, "zqxfollowed", max_results=None, per_file=None, ordered=False).hits
    counts = now.files().agg(F.count("*").alias("files"))
    return counts.select(F.lit(now.commit.version).cast("bigint").alias("version"), "files", F.lit(hits.count()).cast("bigint").alias("hits"))


@query(f"""WITH patterns AS (
  SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN w WHEN 1 THEN regexp_replace(w, '[a-z]', '[a-z]', 'g') ELSE '[0-9]+ ' || substr(w, 1, 1) END AS query
  FROM (SELECT item_id, regexp_extract({lo('text')}, '[a-z]{{4,}}') AS w FROM benchmark) WHERE w <> '')
SELECT query_id, query FROM patterns WHERE len(regexp_extract_all(query, '[a-z0-9_]{{2,}}')) = 0 AND query_id % 3 <> 2""")
def query_guard(spark, sf_dir):
    """Regexes that are refused because they have no literal to look up, out of three kinds made from benchmark items."""
    word = F.regexp_extract(ascii_lower("text"), "[a-z]{4,}", 0)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), word.alias("w")).where("w <> ''")
    kind = F.col("query_id") % 3
    pattern = F.when(kind == 0, F.col("w")).when(kind == 1, F.regexp_replace("w", "[a-z]", "[a-z]")).otherwise(
        F.concat(F.lit("[0-9]+ "), F.substring("w", 1, 1))  # a pair of space and letter is enough
    )
    return batch_errors(items.select("query_id", pattern.alias("query"), F.lit(True).alias("regex"))).select("query_id", "query")


@query("SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS size_bytes FROM documents")
def folder_size(spark, sf_dir):
    """Bytes below a folder that holds every text and a line end each."""
    path = fresh_folder(spark, "sized")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    return spark.createDataFrame([(status_of.index_size(spark, path),)], "size_bytes bigint")


@query(f"SELECT 'all' AS root, CAST(user_id AS VARCHAR) AS path, {KIND} AS kind, epoch_us(ts) AS at_us FROM events "
       "WHERE event_type IN ('click', 'view', 'purchase')")
def read_change_log(spark, sf_dir):
    """Change events from files that land in a folder; those that change no file are passed over."""
    landing, out, mark = (fresh_folder(spark, n) for n in ("landing", "stream", "stream-mark"))
    change_events(spark, sf_dir).write.parquet(landing)
    sink = relevant(read_changes(spark, landing)).writeStream.format("parquet").option("checkpointLocation", mark)
    sink.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("root", "path", "kind", F.unix_micros("ts").alias("at_us"))


# --------------------------------------------------------------------------- folding and batches of queries

FOLDED = """CASE lang WHEN 'en' THEN replace(text, 'tion', 'tİon') WHEN 'fr' THEN replace(text, 'tion', 'tıon')
  WHEN 'de' THEN replace(text, 'keit', 'Keit') ELSE replace(text, 's', 'ſ') END"""
FOLD_PATTERNS = ("tion", "t[h-j]on", "keit", "[j-l]eit", "e[r-t]t", "t[^a-f]on", "worthles[r-t]")


def folded(spark: SparkSession, sf_dir: str) -> TableCorpus:
    df = table(spark, sf_dir, "documents").withColumn("text", F.expr(FOLDED))
    return TableCorpus(df, path=doc_path(), root="source")


@query(f"""WITH docs AS (SELECT source, doc_id, {FOLDED} AS text FROM documents),
lines AS (SELECT source || '/' || doc_id AS file, unnest(string_split(text, chr(10))) AS line_text,
  CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line FROM docs),
asked AS (SELECT unnest([{', '.join(f"'{p}'" for p in FOLD_PATTERNS)}]) AS pattern)
SELECT pattern, strategy, file, line FROM asked, lines, (SELECT unnest(['search', 'scan']) AS strategy)
WHERE regexp_matches(line_text, pattern, 'i')""")
def search_regex_fold(spark, sf_dir):
    """Look-alikes of i, k and s in literals and classes, by whatever strategy the counts suggest and by a scan of all texts."""
    index = index_of(spark, sf_dir, folded)
    texts = split_lines(index.docs("path", "text").select(F.col("path").alias("file"), "text"), regex=True)
    # one scan tests the lines for every pattern
    matched = F.array_compact(F.array(*(F.when(F.col("text").rlike(java_regex(p)), F.lit(p)) for p in FOLD_PATTERNS)))
    scanned = texts.select("file", "line", F.explode(matched).alias("pattern"))
    parts = [scanned.select("pattern", F.lit("scan").alias("strategy"), "file", "line")]
    for pattern in FOLD_PATTERNS:
        found = search(index, pattern, regex=True, max_results=None, per_file=None, ordered=False, allow_scan=True).hits
        parts.append(found.select(F.lit(pattern).alias("pattern"), F.lit("search").alias("strategy"), "file", "line"))
    return reduce(DataFrame.unionByName, parts)


ASKED_MAX = ((1, "tion", 1000), (2, "the", 20), (3, "en", None), (4, "qu", 400))


@query(f"""WITH {LINES}, {GRAMS}, asked AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{q}', {m or 'NULL'})" for i, q, m in ASKED_MAX)}) v(id, query, most)),
met AS (SELECT CAST(id AS BIGINT) AS query_id, most, n_grams, file, line FROM asked JOIN lines ON contains({lo('line_text')}, query)
  JOIN documents d ON file = d.source || '/' || d.doc_id JOIN sizes USING (doc_id))
SELECT query_id, file, line FROM met
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n_grams, file, line) <= coalesce(most, 300)""")
def search_batch_max(spark, sf_dir):
    """Queries with limits of their own above and below the default of 300, and one without."""
    asked = spark.createDataFrame(ASKED_MAX, "query_id long, query string, max int")
    return search_batch(index_of(spark, sf_dir, documents), asked, per_file=None).select("query_id", "file", "line")


@query(f"""WITH {LINES}, words AS (SELECT item_id AS query_id, regexp_extract_all({lo('text')}, '[a-z]{{5,}}') AS w FROM benchmark),
asked AS (SELECT query_id, '(' || w[1] || '|' || w[2] || 's?|' || w[3] || ')[ .,]' AS pattern FROM words WHERE len(w) >= 3)
SELECT query_id, file, CAST(count(*) AS BIGINT) AS n_hits, CAST(sum(line) AS BIGINT) AS line_sum
FROM asked JOIN lines ON regexp_matches(line_text, pattern, 'i') GROUP BY query_id, file""")
def search_batch_either(spark, sf_dir):
    """A regex of three alternatives from the longer words of every benchmark item: a query meets what holds one of their grams."""
    words = F.regexp_extract_all(ascii_lower("text"), F.lit("([a-z]{5,})"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("w")).where(F.size("w") >= 3)
    pattern = F.concat(F.lit("("), F.col("w")[0], F.lit("|"), F.col("w")[1], F.lit("s?|"), F.col("w")[2], F.lit(")[ .,]"))
    asked = items.select("query_id", pattern.alias("query"), F.lit(True).alias("regex"))
    hits = search_batch(index_of(spark, sf_dir, documents), asked, max_results=None, per_file=None)
    return hits.groupBy("query_id", "file").agg(F.count("*").alias("n_hits"), F.sum("line").alias("line_sum"))


@query(f"""WITH {LINES}, asked AS (
  SELECT item_id AS query_id, regexp_extract({lo('text')}, '[a-z]{{4,}}') || '[a-z]*' AS pattern FROM benchmark
  WHERE regexp_extract({lo('text')}, '[a-z]{{4,}}') <> '')
SELECT query_id, file, CAST(count(*) AS BIGINT) AS n_hits, CAST(sum(line) AS BIGINT) AS line_sum
FROM asked JOIN lines ON regexp_matches(line_text, pattern, 'i') GROUP BY query_id, file""")
def search_batch_regex(spark, sf_dir):
    """A regex from the first longer word of every benchmark item, all at once."""
    word = F.regexp_extract(ascii_lower("text"), "[a-z]{4,}", 0)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), word.alias("word")).where("word <> ''")
    asked = items.select("query_id", F.concat("word", F.lit("[a-z]*")).alias("query"), F.lit(True).alias("regex"))
    hits = search_batch(index_of(spark, sf_dir, documents), asked, max_results=None, per_file=None)
    return hits.groupBy("query_id", "file").agg(F.count("*").alias("n_hits"), F.sum("line").alias("line_sum"))


# --------------------------------------------------------------------------- filters of a corpus

TREE = "'/data/' || source || '/' || lang || CASE WHEN doc_id % 7 = 0 THEN '/build/' WHEN doc_id % 11 = 0 THEN '/.cache/' ELSE '/' END || doc_id || CASE WHEN n_chars > 1500 THEN '.log' ELSE '.txt' END"
RULES = (("/data", 2, "*.log\n!keep*/*.log"), ("/data/src1", 2, "!*.log\nbuild/"), ("/data/src2", 1, "/de/\n**/build"), ("/data/src3", 1, "fr/[0-4]*.txt"))


@query(f"""WITH p AS (SELECT doc_id, source, lang, {TREE} AS path FROM documents)
SELECT doc_id FROM p WHERE CASE source
  WHEN 'src1' THEN NOT contains(path, '/build/')
  WHEN 'src2' THEN NOT ends_with(path, '.log') AND lang <> 'de' AND NOT contains(path, '/build/')
  WHEN 'src3' THEN NOT ends_with(path, '.log') AND NOT regexp_matches(path, '^/data/src3/fr/[0-4][^/]*[.]txt$')
  ELSE NOT ends_with(path, '.log') END""")
def ignore_rules(spark, sf_dir):
    """Paths made of the documents' columns, under rules that exclude, re-include and close folders."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.expr(TREE).alias("path"))
    rows = [(d, rank, seq, *rule) for d, rank, text in RULES for seq, rule in enumerate(parse_rules(text))]
    rules = spark.createDataFrame(rows, "dir string, rank int, seq int, regex string, negated boolean, dir_only boolean")
    tops = spark.createDataFrame([("/data/src2",), ("/data/src3",)], "top string")
    return apply_ignore(files, rules, tops).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE NOT contains({TREE}, '/.')")
def hidden_files(spark, sf_dir):
    """Names that start with a dot are left out, whatever lies below them."""
    return drop_hidden(table(spark, sf_dir, "documents").select("doc_id", F.expr(TREE).alias("path"), F.lit("/data").alias("root"))).select("doc_id")


@query("""SELECT doc_id, strlen(text) < 500 AS short_sniff, strlen(text) < 8192 AS first_bytes, true AS anywhere FROM documents""")
def binary_filter(spark, sf_dir):
    """Texts followed by a NUL byte, told binary by their first 500 bytes, the usual 8,192, or all."""
    data = F.concat(F.encode("text", "UTF-8"), F.lit(b"\x00"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", is_binary(data, 500).alias("short_sniff"), is_binary(data).alias("first_bytes"), is_binary(data, None).alias("anywhere")
    )


@query("""SELECT source AS root, CAST(count(*) AS BIGINT) AS listed, CAST(count(*) FILTER (strlen(text) <= 4000) AS BIGINT) AS indexed,
  CAST(count(*) FILTER (strlen(text) > 4000) AS BIGINT) AS too_large, CAST(0 AS BIGINT) AS other FROM documents GROUP BY source""")
def build_report(spark, sf_dir):
    """What a build with a size cap took and left out, per root."""
    df = table(spark, sf_dir, "documents")
    corpus = TableCorpus(df, path=doc_path(), root="source", max_bytes=4000)
    key = (spark.sparkContext.applicationId, sf_dir, "capped")
    if key not in _BUILT:
        _BUILT[key] = build_index(corpus.texts(), fresh_folder(spark, "capped"))
    return status_of.build_report(_BUILT[key], corpus)


TEXTS_PER_FILE = 500    # a file is one document of the index: it must not grow with the table


@query(f"""WITH {LINES} SELECT lang, CAST(count(*) AS BIGINT) AS n_hits, CAST(sum(length({TRIMMED})) AS BIGINT) AS n_chars
FROM lines JOIN documents ON file = source || '/' || doc_id WHERE {ci('en')} AND lang IN ('en', 'de') GROUP BY lang""")
def union_of_roots(spark, sf_dir):
    """Texts written as files of two roots among others, walked, decoded, indexed and searched."""
    key = (spark.sparkContext.applicationId, sf_dir, "roots")
    if key not in _BUILT:
        top = fresh_folder(spark, "tree")
        rows = table(spark, sf_dir, "documents").select("lang", F.col("text").alias("value"))
        rows.write.option("maxRecordsPerFile", TEXTS_PER_FILE).partitionBy("lang").text(top)
        corpus = FileCorpus(spark, [(f"{top}/lang={x}", "utf-8") for x in ("en", "de")], max_bytes=None)
        _BUILT[key] = build_index(corpus.texts(), fresh_folder(spark, "roots"))
    hits = search(_BUILT[key], "en", max_results=None, per_file=None, ordered=False).hits
    lang = F.regexp_extract("file", "/lang=([a-z]+)/", 1).alias("lang")
    return hits.groupBy(lang).agg(F.count("*").alias("n_hits"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT source || '://data/' || doc_id AS path FROM documents WHERE source IN ('src1', 'src2')")
def root_membership(spark, sf_dir):
    """The paths that lie under one of the configured roots."""
    corpus = FileCorpus(spark, [("src1://data", "utf-8"), ("src2://data", "sjis")])
    return corpus.covers(table(spark, sf_dir, "documents").select(F.expr("source || '://data/' || doc_id").alias("path")))


@query(f"""WITH r AS (SELECT DISTINCT source AS path, {ALIAS} AS alias, {CANONICAL} AS encoding FROM documents)
SELECT path, encoding, CAST(row_number() OVER (ORDER BY path, alias) - 1 AS INTEGER) AS seq FROM r""")
def read_root_settings(spark, sf_dir):
    """Roots from a settings file, made of the documents' sources and languages."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.expr(ALIAS).alias("encoding")).distinct()
    one = rows.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("path", "encoding"))).alias("roots"))).alias("value"))
    folder = fresh_folder(spark, "settings")
    one.coalesce(1).write.text(folder)
    (name,) = [n for n in Folder(spark, folder).names() if n.startswith("part-")]
    return read_roots(spark, f"{folder}/{name}")


# --------------------------------------------------------------------------- Japanese encodings

KANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのは"
JAPANESE = f"regexp_replace(translate({lo('text')}, '{LOWER}', '{KANA}'), '[^\x00-\x7F{KANA}]', '・{{}}')".replace("{}", "")
JAPANESE_DUCK = JAPANESE[:-1] + ", 'g')"
# The same for Spark: what is beyond ASCII is looked for before the letters turn, so a text mostly passes one cheap class. Where bytes
# are no UTF-8, ``translate`` and a regex part them into other characters, and the order stays.
JAPANESE_SPARK = f"""CASE WHEN is_valid_utf8(text)
  THEN translate(regexp_replace(text, '[^\x00-\x7F](?<![{KANA}])', '・'), '{UPPER}{LOWER}', '{KANA}{KANA}')
  ELSE {JAPANESE} END"""


def japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in kana, as bytes of Shift_JIS for one half of the languages and of EUC-JP for the other."""
    rows = table(spark, sf_dir, "documents").withColumn("text", F.expr(JAPANESE_SPARK))
    sjis = F.col("lang").isin("en", "fr")
    data = F.when(sjis, F.encode("text", "windows-31j")).otherwise(F.encode("text", "EUC-JP"))
    return rows.select("doc_id", "source", data.alias("content"), F.when(sjis, "shift_jis").otherwise("euc-jp").alias("enc"))


def japanese_texts(spark: SparkSession, sf_dir: str) -> TableCorpus:
    return TableCorpus(japanese(spark, sf_dir), path=doc_path(), text=decode_text("content", "enc"))


@query(f"SELECT doc_id, md5({JAPANESE_DUCK}) AS decoded FROM documents")
def decoded_japanese(spark, sf_dir):
    """Two- and one-byte characters of Shift_JIS and EUC-JP, decoded."""
    return japanese(spark, sf_dir).select("doc_id", F.md5(decode_text("content", "enc").cast("binary")).alias("decoded"))


@query(hits_sql("contains(line_text, 'とけそ')").replace("FROM documents", f"FROM (SELECT source, doc_id, {JAPANESE_DUCK} AS text FROM documents)"))
def search_japanese(spark, sf_dir):
    """A search in texts that were Shift_JIS and EUC-JP bytes."""
    return search(index_of(spark, sf_dir, japanese_texts), "とけそ", max_results=None, per_file=None, ordered=False).hits


# --------------------------------------------------------------------------- builds, opening, output


@query("SELECT event_id, epoch_us(ts) // 1000 AS at_ms FROM events")
def epoch_millis_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", epoch_millis(F.col("ts").cast("timestamp")).alias("at_ms"))


@query(f"""SELECT '[' || string_agg('{{"file":"' || file || '","line":' || line || ',"text":' || to_json(text) || '}}', ',' ORDER BY file, line) || ']' AS value
FROM ({hits_sql(ci('worthless'))})""")
def hit_json_array(spark, sf_dir):
    """All hits of a rare query as one array."""
    return json_array(doc_hits(spark, sf_dir, "worthless"))


@query(f"""WITH h AS (
  SELECT '{{"file":"' || file || '","line":' || line || ',"text":' || to_json(text) || '}}' AS j, row_number() OVER (ORDER BY file, line) AS k
  FROM ({hits_sql(ci('tion'))}))
SELECT CASE k WHEN 1 THEN '[' ELSE ',' END || j AS value FROM h UNION ALL SELECT ']'""")
def hit_json_array_file(spark, sf_dir):
    """All hits of a common query as one array, a line each."""
    path = fresh_folder(spark, "array")
    write_json_array(doc_hits(spark, sf_dir, "tion"), path)
    return spark.read.text(path)


@query(f"""WITH h AS ({hits_sql(ci('worthless'))})
SELECT '{{"id":7,"type":"match","file":"' || file || '","line":' || line || ',"text":' || to_json(text) || '}}' AS value FROM h
UNION ALL SELECT '{{"id":7,"type":"done","hits":' || count(*) || ',"truncated":false}}' FROM h""")
def hit_messages(spark, sf_dir):
    """A match for each hit, then how many there were."""
    found = search(index_of(spark, sf_dir, documents), "worthless", max_results=None, per_file=None)
    return json_messages(found, 7).select("value")


@query(f"""WITH h AS ({ORACLES['search_candidate_limit']})
SELECT CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT file) AS BIGINT) AS files, true AS candidates_truncated FROM h""")
def hit_summary_truncated(spark, sf_dir):
    """The summary of a search whose candidate limit was reached."""
    return search(index_of(spark, sf_dir, documents), "tion", max_results=None, per_file=None, candidate_limit=40).summary()


@query(f"""WITH {OLD}, {NEW} SELECT path, mtime, size FROM new
UNION ALL SELECT path, mtime, size FROM old WHERE path NOT IN (SELECT path FROM new)""")
def build_unforced(spark, sf_dir):
    """A second build without force: documents are replaced by path, those that vanished stay; then opened anew."""
    key = (spark.sparkContext.applicationId, sf_dir, "unforced")
    if key not in _BUILT:
        where = fresh_folder(spark, "unforced")
        build_index(before(spark, sf_dir).texts(), where)
        build_index(after(spark, sf_dir).texts(), where, force=False)
        _BUILT[key] = open_index(spark, where)
    return _BUILT[key].files().select("path", "mtime", "size")


@query(ORACLES["search_synced"])
def search_fresh_index(spark, sf_dir):
    """An index of an earlier state, caught up with the later one just before the search."""
    key = (spark.sparkContext.applicationId, sf_dir, "fresh")
    if key not in _BUILT:
        _BUILT[key] = build_index(before(spark, sf_dir).texts(), fresh_folder(spark, "fresh"))
    options = {"max_results": None, "per_file": None, "ordered": False}
    _BUILT[key], found = search_fresh(_BUILT[key], "tion", after(spark, sf_dir), **options)
    return found.hits


@query(f"WITH {NEW}, {GRAMS} SELECT gram, CAST(count(*) AS BIGINT) AS n FROM grams JOIN documents d USING (doc_id) "
       "JOIN new ON path = d.source || '/' || d.doc_id WHERE gram IN ('tio', 'ion', 'th', 'que', 'ß', 'ung') GROUP BY gram")
def gram_frequency_live(spark, sf_dir):
    """Documents per gram in an index where some are retired, which do not count."""
    return live_frequency(_synced(spark, sf_dir), ["tio", "ion", "th", "que", "ß", "ung"])


@query(f"""SELECT regexp_replace(file, '^src1/', '') || ':' || line || ': ' || text AS value FROM ({hits_sql(ci('worth'))})
UNION ALL SELECT 'No matches.'""")
def hit_text_relative(spark, sf_dir):
    """Hits as text relative to one root, and the line that stands for none."""
    found = format_hits(doc_hits(spark, sf_dir, "worth"), "src1", NO_MATCHES)
    return found.unionByName(format_hits(doc_hits(spark, sf_dir, "zqxvzq"), "src1", NO_MATCHES))
