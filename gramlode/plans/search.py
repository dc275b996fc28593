"""Searching: compile a query on the driver, narrow by grams, verify lines exactly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.constants import (
    BROADCAST_ROWS,
    EARLY_STOP_DOCS,
    EARLY_STOP_STEP,
    HITS_PER_FILE,
    LOOKUP_MOST,
    LOOKUP_ROWS,
    LOOKUP_SHARE,
    LOOKUP_STEP,
    MAX_RESULTS,
    PREFILTER_GRAMS,
)
from gramlode.functions import regex as rx
from gramlode.functions.gramplan import ALL, Tree, all_of, gram, gram_tree
from gramlode.functions.text import query_ngrams
from gramlode.operators.candidates import candidates, tree_keys
from gramlode.operators.hits import search_summary
from gramlode.operators.index import Index
from gramlode.operators.lines import Verifier, hits_of, regex_verifier, substring_verifier
from gramlode.session import fresh_folder

GRAMS_OF_LINE = 64              # grams looked for in a line before a regex
HITS_SCHEMA = "file string, line int, text string"


@dataclass(frozen=True)
class Query:
    """A compiled query: the tree of grams a match satisfies and the check of a candidate."""

    tree: Tree
    verifier: Verifier | None       # None: no text can match

    @property
    def grams(self) -> list[str]:
        """The grams that every match has."""
        return self.tree.required()


@dataclass
class SearchOutcome:
    """Hits in result order, and whether the candidate limit may have cut some off."""

    hits: DataFrame
    candidates_truncated: bool = False

    def summary(self) -> DataFrame:
        """One row: hits, files, candidates_truncated."""
        return search_summary(self.hits, self.candidates_truncated)


def compile_query(
    query: str,
    regex: bool = False,
    case_sensitive: bool = False,
    *,
    prefilter: str = "sound",
    allow_scan: bool = False,
    allow_nested: bool = True,
) -> Query:
    """Grams and verifier of a query.

    A substring below two characters matches nothing. A regex that has neither a literal run nor any gram to ask for raises,
    unless ``allow_scan``. ``prefilter='compat'`` requires every literal run of a regex whatever its place
    in the pattern, which loses matches of alternations, optional parts, classes and escapes.
    """
    if prefilter not in ("sound", "compat"):
        raise ValueError("prefilter is 'sound' or 'compat'")
    if not regex:
        if len(query) < 2:
            return Query(ALL, None)
        return Query(all_of(map(gram, query_ngrams(query))), substring_verifier(query, case_sensitive))
    if not allow_nested and rx.nested_repeats(query):
        raise ValueError("an unbounded repetition within another can take Java very long on a line")
    runs = rx.extract_literals(query)
    tree = gram_tree(query, case_sensitive) if prefilter == "sound" else all_of(map(gram, query_ngrams(*runs)))
    if not runs and tree == ALL and not allow_scan:
        raise ValueError(rx.NO_LITERAL)
    # every match has one of the sets, and lies within a line
    sets = tuple(tuple(s) for s in tree.options()) if prefilter == "sound" else ()
    few = sum(map(len, sets)) <= GRAMS_OF_LINE
    return Query(tree, regex_verifier(rx.java_regex(query, case_sensitive), sets if few else ()))


def search(
    index: Index,
    query: str,
    *,
    regex: bool = False,
    case_sensitive: bool = False,
    max_results: int | None = MAX_RESULTS,
    per_file: int | None = HITS_PER_FILE,
    candidate_limit: int | None = None,
    prefilter: str = "sound",
    allow_scan: bool = False,
    allow_nested: bool = True,
    ordered: bool = True,
    corpus=None,
) -> SearchOutcome:
    """Lines that hold a substring or match a regex.

    Hits come by the file's number of distinct grams, then path, then line. ``max_results=None`` and
    ``per_file=None`` lift the caps; then ``ordered=False`` spares the sort of all hits, for those who count or filter them. ``candidate_limit`` verifies only that many best candidates
    (``constants.CANDIDATE_LIMIT`` is the customary value) and reports when it was reached; by
    default every candidate is verified. ``allow_nested=False`` refuses patterns such as ``(a+)+``.

    The text comes from the index when it stores it, else from ``corpus``, in its present state:
    files that vanished drop out, and text written after the last sync is found only in files that
    are candidates by their indexed grams.
    """
    spark = index.spark
    compiled = compile_query(query, regex, case_sensitive, prefilter=prefilter, allow_scan=allow_scan, allow_nested=allow_nested)
    nothing = SearchOutcome(spark.createDataFrame([], HITS_SCHEMA))
    if compiled.verifier is None or not index.commit.segments:
        return nothing
    if regex:
        rx.check_java(spark, rx.java_regex(query, case_sensitive))
    if corpus is None and not index.commit.has_text:
        raise ValueError("this index keeps no text: pass corpus=")

    counts = index.count_of(sorted(compiled.tree.grams()))
    bound = compiled.tree.bound(counts, index.commit.file_count)
    if bound == 0:
        return nothing

    truncated = False
    if corpus is not None:
        hits, truncated = _reread(index, compiled, bound, candidate_limit, corpus, per_file)
    elif candidate_limit is not None:
        rows, truncated = _stored_top(index, compiled, bound, candidate_limit)
        hits = hits_of(rows, compiled.verifier, per_file, "n_grams")
    elif (first := _early(index, compiled, bound, max_results, per_file)) is not None:
        hits = first
    else:
        exact = regex and prefilter == "compat"
        rows = _stored(index, compiled, counts, bound, exact)
        hits = hits_of(rows, compiled.verifier, per_file, "seg", "doc", "n_grams")
        if exact and bound > lookup_limit(index):
            hits = hits.join(tree_keys(index, compiled.tree), ["seg", "doc"], "left_semi")
        hits = index.live(hits)

    if ordered or max_results is not None:
        hits = hits.orderBy("n_grams", "file", "line")
    if max_results is not None:
        hits = hits.limit(max_results)
    return SearchOutcome(hits.select("file", "line", "text"), truncated)


def lookup_limit(index: Index) -> int:
    """How many documents are better fetched by number than found by a scan."""
    return int(min(LOOKUP_ROWS, max(LOOKUP_STEP, LOOKUP_SHARE * index.commit.file_count)))


def _stored(index: Index, compiled: Query, counts: dict[str, int], bound: int, exact: bool) -> DataFrame:
    """(seg, doc, path, n_grams, text) to verify, from the stored text; retired rows among them.

    A rare query fetches its documents by number: the counts of its grams prove that their
    list is short. A common one reads the text column once and tests it directly; a join with a
    long candidate list would read the same pages and add a shuffle. The two give the same hits
    because every match is a candidate, except where the prefilter itself decides (``exact``).
    """
    if compiled.tree == ALL or bound > lookup_limit(index):
        return index.docs("path", "n_grams", "text", live=False)
    keys = tree_keys(index, compiled.tree if exact else compiled.tree.thinned(counts, PREFILTER_GRAMS)).collect()
    return index.docs_numbered(keys, "path", "n_grams", "text")


def _stored_top(index: Index, compiled: Query, bound: int, limit: int) -> tuple[DataFrame, bool]:
    """The best candidates only: few are fetched by number, many are met by one scan.

    The best are found by narrow columns, each task keeping its own best. More than ``LOOKUP_MOST`` are written as a table, so
    that they are found once, counted, and stay off the driver; the scan of the texts meets them broadcast where their number allows.
    """
    if compiled.tree == ALL:
        keys = index.docs("path", "n_grams").orderBy("n_grams", "path").limit(limit)
    else:
        keys = candidates(index, compiled.tree, limit, bound)
    keys = keys.select("seg", "doc")
    if min(limit, bound) <= LOOKUP_MOST:
        chosen = keys.collect()
        return index.docs_numbered(chosen, "path", "n_grams", "text"), len(chosen) >= limit
    folder = fresh_folder(index.spark, "best")
    keys.write.parquet(folder)
    best = index.spark.read.schema(keys.schema).parquet(folder)
    count = best.count()
    few = F.broadcast(best) if count <= BROADCAST_ROWS else best
    return index.docs("path", "n_grams", "text", live=False).join(few, ["seg", "doc"], "left_semi"), count >= limit


def _early(index: Index, compiled: Query, bound: int, max_results: int | None, per_file: int | None) -> DataFrame | None:
    """Hits that hold the first ``max_results``, from a growing number of the best candidates; None where that is no gain.

    Hits come in the order of their documents, so when some candidates give enough, no later one can
    come before. Ranking reads narrow columns only; the texts read are those of the best candidates.
    """
    if max_results is None or compiled.tree == ALL or index.commit.file_count < EARLY_STOP_DOCS or bound <= lookup_limit(index):
        return None
    limit = max(EARLY_STOP_STEP, max_results)
    while limit <= min(bound, LOOKUP_MOST):
        rows, more = _stored_top(index, compiled, bound, limit)
        hits = hits_of(rows, compiled.verifier, per_file, "n_grams")
        if not more or hits.limit(max_results).count() == max_results:
            return hits
        limit *= 4
    return None


def _reread(
    index: Index, compiled: Query, bound: int, limit: int | None, corpus, per_file: int | None
) -> tuple[DataFrame, bool]:
    """Hits of the candidates in the corpus as it is now."""
    if compiled.tree != ALL:
        found = candidates(index, compiled.tree, limit, bound)
    else:
        found = index.docs("path", "root", "enc", "mtime", "size", "n_grams")
        found = found if limit is None else found.orderBy("n_grams", "path").limit(limit)
        bound = index.commit.file_count
    truncated = limit is not None and found.count() >= limit
    bound = bound if limit is None else min(bound, limit)

    def verify(rows: DataFrame) -> DataFrame:
        return hits_of(rows, compiled.verifier, per_file, *(["n_grams"] if "n_grams" in rows.columns else []))

    return corpus.reread(found.select("path", "root", "enc", "size", "n_grams"), bound, verify), truncated
