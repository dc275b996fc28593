"""What happens to hits after the search: filters, grouping, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.functions.paths import path_matches, rel_path
from gramlode.functions.text import hit_json


def filter_paths(
    hits: DataFrame, include: str = "", exclude: str = "", path: Column | str = "file"
) -> DataFrame:
    """Keep hits whose path matches ``include`` and not ``exclude``; blank patterns do nothing.

    Runs on finished hits, so after the result limit.
    """
    kept = hits.where(path_matches(path, include))
    return kept.where(~path_matches(path, exclude)) if exclude.strip() else kept


def group_hits(hits: DataFrame) -> DataFrame:
    """Per file: number of hits and its rows by line.

    The per-file cap of a search bounds a group; for uncapped hits use ``count_hits``.
    """
    return hits.groupBy("file").agg(
        F.count("*").alias("n_hits"),
        F.sort_array(F.collect_list(F.struct("line", "text"))).alias("rows"),
    )


def count_hits(hits: DataFrame) -> DataFrame:
    """Per file: number of hits."""
    return hits.groupBy("file").agg(F.count("*").alias("n_hits"))


def search_summary(hits: DataFrame, candidates_truncated: bool = False) -> DataFrame:
    """One row: hits, files, candidates_truncated."""
    per_file = count_hits(hits)
    return per_file.agg(
        F.coalesce(F.sum("n_hits"), F.lit(0)).alias("hits"),
        F.count("*").alias("files"),
        F.lit(candidates_truncated).alias("candidates_truncated"),
    )


def format_hits(hits: DataFrame, root: str = "", empty: str | None = None) -> DataFrame:
    """``path:line: text`` per hit, relative to ``root``; the line ``empty``, if given, where there is no hit."""
    shown = rel_path("file", F.lit(root)) if root else F.col("file")
    lines = hits.select(F.concat(shown, F.lit(":"), F.col("line"), F.lit(": "), F.col("text")).alias("value"))
    if empty is None:
        return lines
    none = hits.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(empty).alias("value"))
    return lines.unionByName(none)


def json_lines(hits: DataFrame) -> DataFrame:
    """One JSON object per hit."""
    return hits.select(hit_json().alias("value"))


def json_array(hits: DataFrame) -> DataFrame:
    """All hits as one JSON array in one row; for a search with a result limit. ``write_json_array`` takes any number."""
    rows = F.sort_array(F.collect_list(F.struct("file", "line", "text")))
    return hits.agg(F.to_json(rows).alias("value"))


def json_messages(outcome, query_id: int | str) -> DataFrame:
    """(place, value): a ``match`` object for each hit of a search, in result order, and a last one that says ``done``, how many, and whether cut.

    ``place`` counts within the tasks of an ordered search and rises from task to task.
    """
    name = F.lit(query_id).alias("id")
    found = outcome.hits.withColumn("place", F.monotonically_increasing_id())
    match = F.to_json(F.struct(name, F.lit("match").alias("type"), "file", "line", "text"))
    done = F.to_json(F.struct(name, F.lit("done").alias("type"), "hits", F.lit(outcome.candidates_truncated).alias("truncated")))
    total = found.agg(F.count("*").alias("hits"))
    last = F.lit(2**63 - 1).cast("bigint").alias("place")
    return found.select("place", match.alias("value")).unionByName(total.select(last, done.alias("value")))


def write_json_array(hits: DataFrame, path: str) -> None:
    """Hits as one JSON array, a line each, in files whose names give their order: however many they are, none holds them all.

    The text is the concatenation of the files, as ``getmerge`` makes it. A hit is told by file and line.
    """
    least = hits.orderBy("file", "line").select("file", "line").first()
    opens = F.lit(False) if least is None else (F.col("file") == least["file"]) & (F.col("line") == least["line"])
    # the first hit opens the array, each other one brings the comma before it
    lines = hits.select(F.lit(0).alias("rank"), "file", "line", F.concat(F.when(opens, "[").otherwise(","), hit_json()).alias("value"))
    end = hits.sparkSession.createDataFrame([(1, None, None, "[]" if least is None else "]")], "rank int, file string, line int, value string")
    order = ["rank", "file", "line"]
    lines.unionByName(end).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def write_json(hits: DataFrame, path: str) -> None:
    """Hits as JSON lines."""
    hits.select("file", "line", "text").write.json(path)


NO_MATCHES = "No matches."


def write_text(hits: DataFrame, path: str, root: str = "") -> None:
    """Hits as ``path:line: text`` lines, or a line that says there are none."""
    format_hits(hits, root, NO_MATCHES).write.text(path)
