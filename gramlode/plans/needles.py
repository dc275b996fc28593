"""Many substrings at once: one pass of an Aho-Corasick automaton over each text.

The needles travel to the tasks in blocks of bounded size; a task builds a block's automaton once and runs it over the texts it scans, so
the work follows the length of the texts and the number of hits, not the number of queries for each text. Needles without a line
break lie within a line, and a line counts once for each query. A text leaves the task once, with the numbers of its hits; they become rows in Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.session import small_batches

BLOCK_BYTES = 16 * 1024 * 1024  # of needles in one automaton
BATCH_HITS = 1 << 18            # hits of one row, and of one batch, that leave a task
MATCHES_HELD = 1 << 20          # matches of a text looked at together
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def lowered(text: str) -> str:
    """ASCII letters lowered, all others as they are: what bytes are lowered by."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def blocks_of(needles: Iterable[tuple[int, str, bool]], most: int = BLOCK_BYTES) -> list[list[tuple[int, str, bool]]]:
    """(query_id, needle, case_sensitive) in blocks of at most ``most`` bytes of needles, but at least one needle."""
    blocks: list[list] = []
    held = most + 1
    for item in needles:
        size = len(item[1].encode("utf-8", "surrogatepass")) + 16
        if held + size > most:
            blocks.append([])
            held = 0
        blocks[-1].append(item)
        held += size
    return blocks


@dataclass(frozen=True)
class Needles:
    """An automaton that tells numbers of needles, and the queries of each: those of needle k are ``queries[starts[k]:starts[k + 1]]``."""

    automaton: Any
    queries: np.ndarray
    starts: np.ndarray


def automaton_of(needles: list[tuple[int, str]]) -> Needles | None:
    """The automaton of the needles, each with its queries; None without any."""
    import ahocorasick

    queries: dict[str, dict[int, None]] = {}
    for query, needle in needles:
        queries.setdefault(needle, {})[query] = None
    if not queries:
        return None
    automaton = ahocorasick.Automaton()
    for k, needle in enumerate(queries):
        automaton.add_word(needle, k)
    automaton.make_automaton()
    own = np.array([q for qs in queries.values() for q in qs], np.int64)
    return Needles(automaton, own, np.cumsum([0, *(len(qs) for qs in queries.values())]))


def found_in(needles: Needles, text: str, breaks: np.ndarray, per_file: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Queries and lines, from 0, of the lines that hold a needle, at most ``per_file`` for a query; ``breaks`` are the line ends."""
    lines = len(breaks) + 1
    matches, keys = needles.automaton.iter(text), np.zeros(0, np.int64)
    while some := list(islice(matches, MATCHES_HELD)):
        ends, needle = np.array(some, np.int64).T
        new = np.unique(needle * lines + np.searchsorted(breaks, ends))
        keys = np.union1d(keys, new) if len(keys) else new
    needle, line = np.divmod(keys, lines)
    if per_file is not None:
        kept = np.arange(len(keys)) - np.searchsorted(needle, needle) < per_file
        needle, line = needle[kept], line[kept]
    counts = needles.starts[needle + 1] - needles.starts[needle]
    at = np.arange(counts.sum()) + np.repeat(needles.starts[needle] - (np.cumsum(counts) - counts), counts)
    return needles.queries[at], np.repeat(line, counts)


def lines_with(needles: Needles, text: str, breaks: list[int], per_file: int | None) -> Iterator[tuple[int, int]]:
    """``found_in`` as pairs of (query, line)."""
    return zip(*(a.tolist() for a in found_in(needles, text, np.array(breaks, np.int64), per_file)), strict=True)


def needle_hits(docs: DataFrame, needles: Iterable[tuple[int, str, bool]], per_file: int | None, *columns: str) -> DataFrame:
    """(columns, query_id, line, text) of every line of ``docs`` (columns, text) that holds a needle (query_id, needle, case_sensitive).

    A needle that ignores case is lowered already. One scan of the texts for each block of needles.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*columns, "text")
    fields = [f for f in kept.schema if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    schema += ", _before int, _lines array<string>, _found array<struct<query_id:bigint,line:int>>"
    names = [f.name for f in fields] + ["_before", "_lines", "_found"]

    def searching(block: list[tuple[int, str, bool]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            exact = automaton_of([(q, n) for q, n, case in block if case])
            folded = automaton_of([(q, n) for q, n, case in block if not case])
            for batch in batches:
                rows, held, texts = [], 0, batch.column("text")

                def made() -> pa.RecordBatch:
                    place, before, lines, queries, at = zip(*rows, strict=True)
                    found = pa.StructArray.from_arrays([pa.array(np.concatenate(queries)), pa.array(np.concatenate(at).astype(np.int32))], ["query_id", "line"])
                    offsets = pa.array(np.cumsum([0, *map(len, queries)]), pa.int32())
                    own = [batch.column(f.name).take(pa.array(place, pa.int64())) for f in fields]
                    own += [pa.array(before, pa.int32()), pa.array(lines, pa.list_(pa.string())), pa.ListArray.from_arrays(offsets, found)]
                    return pa.RecordBatch.from_arrays(own, names)

                for row in range(batch.num_rows):
                    text = texts[row].as_py()
                    if not text:
                        continue
                    lines = text.split("\n")
                    breaks = np.cumsum([len(line) + 1 for line in lines[:-1]], dtype=np.int64) - 1
                    parts = [found_in(n, t, breaks, per_file) for n, t in ((exact, text), (folded, lowered(text) if folded else "")) if n]
                    queries, at = (np.concatenate(p) for p in zip(*parts, strict=True))
                    order = np.argsort(at, kind="stable")
                    for first in range(0, len(order), BATCH_HITS):  # the hits of a long text leave in several rows, each with its own lines
                        some = order[first : first + BATCH_HITS]
                        low, high = int(at[some[0]]), int(at[some[-1]])
                        rows.append((row, low, [x.rstrip(WHITE_SPACE) for x in lines[low : high + 1]], queries[some], at[some] + 1))
                        held += len(some)
                        if held >= BATCH_HITS:
                            yield made()
                            rows, held = [], 0
                if rows:
                    yield made()

        return run

    parts = [kept.mapInArrow(searching(block), schema) for block in blocks_of(needles)]
    hits = reduce(DataFrame.unionByName, parts).select(*columns, "_before", "_lines", F.inline("_found"))
    return hits.select(*columns, "query_id", "line", F.get("_lines", F.col("line") - 1 - F.col("_before")).alias("text"))
