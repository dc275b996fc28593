"""Catch up first, then search."""

from __future__ import annotations

from gramlode.operators.index import Index
from gramlode.operators.sync import sync
from gramlode.plans.search import SearchOutcome, search


def search_fresh(index: Index, query: str, corpus, **options) -> tuple[Index, SearchOutcome]:
    """Sync the index with its corpus, then search it.

    A failed sync fails the search: stale results would look like fresh ones. ``search`` alone gives those of the last sync.
    """
    index, _ = sync(index, corpus)
    if not index.commit.has_text:
        options.setdefault("corpus", corpus)
    return index, search(index, query, **options)
