"""Which of many queries a text, or a line of it, can answer: those one of whose sets of grams it has, found before anything is checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gramlode.constants import FOLDING_TO_ASCII
from gramlode.plans.needles import automaton_of, found_in, lowered

COUNTS_HELD = 8_000_000         # counters of (text, set) at once

Asked = list[tuple[int | None, list[list[str]]]]
Batches = Iterator[pa.RecordBatch]


class Sets:
    """Sets of grams of queries, and which queries have a whole set within given grams.

    ``asked`` holds each query once, with sets of distinct grams.
    """

    def __init__(self, asked: Asked):
        names: dict[str, int] = {}
        members = [(names.setdefault(g, len(names)), k) for k, s in enumerate(s for _, sets in asked for s in sets) for g in s]
        gram, self.member = np.array(sorted(members), np.int64).reshape(-1, 2).T
        self.grams = list(names)
        self.sizes = np.array([len(s) for _, sets in asked for s in sets], np.int64)
        self.query_of = np.repeat(np.arange(len(asked)), [len(sets) for _, sets in asked])
        self.starts = np.searchsorted(gram, np.arange(len(names) + 1))
        self.ids = pa.array([q for q, _ in asked], pa.int64())

    def met(self, place: np.ndarray, gram: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, query) by number, in order, of the places below ``places`` whose distinct grams (place, gram), in order of place, hold a set."""
        starts, sizes, queries = self.starts, self.sizes, len(self.ids)
        step, found = max(1, COUNTS_HELD // max(1, len(sizes))), [np.zeros(0, np.int64)]
        for first in range(0, places, step):
            a, b = np.searchsorted(place, [first, first + step])
            counts = starts[gram[a:b] + 1] - starts[gram[a:b]]
            entries = np.arange(counts.sum()) + np.repeat(starts[gram[a:b]] - (np.cumsum(counts) - counts), counts)
            seen = np.bincount(np.repeat(place[a:b] - first, counts) * len(sizes) + self.member[entries], minlength=1)
            cell = np.flatnonzero(seen)
            cell = cell[seen[cell] == sizes[cell % len(sizes)]]
            found.append(np.unique((cell // len(sizes) + first) * queries + self.query_of[cell % len(sizes)]))
        return np.divmod(np.concatenate(found), max(1, queries))


def meeting_queries(asked: Asked) -> Callable[[Batches], Batches]:
    """A function from batches with ``grams`` to batches with ``asked`` instead: the query_ids that a text meets; others drop out."""

    def run(batches: Batches) -> Batches:
        sets = Sets(asked)
        for batch in batches:
            lists = batch.column("grams")
            at = pc.index_in(lists.flatten(), value_set=pa.array(sets.grams, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
            place = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            text, query = sets.met(place[at >= 0], at[at >= 0], len(lists))
            kept, counts = np.unique(text, return_counts=True)
            if len(kept):
                rest = batch.drop_columns(["grams"]).take(pa.array(kept))
                own = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), sets.ids.take(pa.array(query)))
                yield pa.RecordBatch.from_arrays([*rest.columns, own], [*rest.schema.names, "asked"])

    return run


def meeting_lines(asked: Asked) -> Callable[[Batches], Batches]:
    """A function from batches with ``text`` to batches with (asked, lines) instead: a row for each text and query, with the lines that may match.

    A match of a regex lies within a line, and so does one whole set of grams. Lines are numbered from 1, without a carriage return at
    the end. Rows come by query, for which a pattern is compiled once.
    """

    def run(batches: Batches) -> Batches:
        sets = Sets(asked)
        grams = automaton_of(list(enumerate(sets.grams)))
        for batch in batches:
            rows, texts = [], batch.column("text")
            for row in range(batch.num_rows if grams else 0):
                text = texts[row].as_py()
                if not text:
                    continue
                lines = text.split("\n")
                breaks = np.cumsum([len(line) + 1 for line in lines[:-1]], dtype=np.int64) - 1
                folded = lowered(text)
                for source, target in FOLDING_TO_ASCII.items():
                    folded = folded.replace(source, target)
                gram, line = found_in(grams, folded, breaks, None)
                order = np.argsort(line, kind="stable")
                line, query = sets.met(line[order], gram[order], len(lines))
                order = np.argsort(query, kind="stable")
                line, query = line[order], query[order]
                first = np.flatnonzero(np.diff(query, prepend=-1))
                for q, some in zip(query[first].tolist(), np.split(line, first[1:]) if len(first) else ()):
                    rows.append((q, row, [(k + 1, lines[k].removesuffix("\r")) for k in some.tolist()]))
            if rows:
                rows.sort(key=lambda r: r[:2])
                query, place, held = zip(*rows)
                rest = batch.drop_columns(["text"]).take(pa.array(place))
                own = [sets.ids.take(pa.array(query)), pa.array(held, pa.list_(pa.struct([("line", pa.int32()), ("text", pa.string())])))]
                yield pa.RecordBatch.from_arrays([*rest.columns, *own], [*rest.schema.names, "asked", "lines"])

    return run
