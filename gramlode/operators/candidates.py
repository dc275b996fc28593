"""Candidate retrieval: the files whose gram set holds every gram of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.constants import BROADCAST_ROWS
from gramlode.functions.gramplan import Tree, all_of, gram
from gramlode.operators.index import Index


def tree_keys(index: Index, tree: Tree) -> DataFrame:
    """(seg, doc) of documents whose grams satisfy the tree; retired documents are still among them.

    Only the buckets of the tree's grams are read. The lists of a block come together in one aggregation, as a map from gram
    to list, and the tree is worked out on them: a group holds one bounded list per gram, whatever the size of the corpus.
    """
    required = tree.required()
    if tree.grams() == set(required):
        return candidate_keys(index, required)
    lists = index.postings(sorted(tree.grams()))
    entries = F.collect_list(F.struct("gram", "docs")).alias("entries")
    met = lists.groupBy("seg", "block").agg(entries, F.collect_set(F.when(F.col("gram").isin(required), F.col("gram"))).alias("have"))
    # blocks that lack a required gram vanish before any list is touched
    met = met.where(F.size("have") == len(required)).withColumn("lists", F.map_from_entries("entries"))
    return met.select("seg", F.explode(tree.documents(F.col("lists"))).alias("doc"))


def candidate_keys(index: Index, grams: list[str]) -> DataFrame:
    """(seg, doc) of documents holding all grams; retired documents are still among them.

    One aggregation serves any number of grams: the lists of a block come together, blocks that
    lack a gram vanish, the lists of the others are intersected. A group holds one bounded list per
    gram, whatever the size of the corpus.
    """
    lists = index.postings(grams)
    if len(grams) < 2:
        return lists.select("seg", F.explode("docs").alias("doc"))
    met = lists.groupBy("seg", "block").agg(F.collect_list("docs").alias("lists"))
    # Exploding the expression itself: a named column would be computed again for a null filter.
    both = F.aggregate("lists", F.get("lists", F.lit(0)), F.array_intersect)
    return met.where(F.size("lists") == len(grams)).select("seg", F.explode(both).alias("doc"))


def candidates(
    index: Index, grams: list[str] | Tree, limit: int | None = None, bound: int | None = None
) -> DataFrame:
    """Live candidate files: seg, doc and the file columns.

    ``grams`` are those a candidate holds all of, or a tree of AND and OR. ``limit`` keeps the best ones: all candidates hold
    the same terms once, so the ranking is by the number of distinct grams of the file, fewest first, then by path. ``bound``
    is an upper bound on the candidates, looked up when not given.
    """
    tree = grams if isinstance(grams, Tree) else all_of(map(gram, grams))
    if bound is None:
        bound = tree.bound(index.count_of(sorted(tree.grams())), index.commit.file_count)
    keys = tree_keys(index, tree)
    if bound <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    files = index.docs("path", "root", "enc", "mtime", "size", "n_grams").join(keys, ["seg", "doc"])
    files = files.withColumn("enc", F.coalesce("enc", F.lit("utf-8")))
    return files if limit is None else files.orderBy("n_grams", "path").limit(limit)


def gram_document_frequency(index: Index, grams: list[str]) -> DataFrame:
    """(gram, n): live documents that hold each of the given grams."""
    rows = index.live(index.pairs(grams))
    return rows.groupBy("gram").agg(F.count("*").alias("n"))
