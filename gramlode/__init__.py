"""Indexed text search on Spark: build a gram index over texts, keep it current, search it."""

from gramlode.operators.candidates import candidates, gram_document_frequency
from gramlode.operators.hits import (
    count_hits,
    filter_paths,
    format_hits,
    group_hits,
    json_array,
    json_lines,
    json_messages,
    search_summary,
    write_json,
    write_json_array,
    write_text,
)
from gramlode.operators.index import Index, build_index, compact, foldable, is_built, open_index, vacuum
from gramlode.operators.status import build_report, build_totals, document_count, index_size, index_status
from gramlode.operators.sync import SyncStats, apply_changes, sync
from gramlode.plans.batch import batch_errors, search_batch
from gramlode.plans.fresh import search_fresh
from gramlode.plans.search import SearchOutcome, search
from gramlode.session import configure, fresh_folder, local_session, shared_folder
from gramlode.sources.files import FileCorpus, parse_root_specs, read_roots, resolve_roots, scan_corpus
from gramlode.sources.tables import TableCorpus
from gramlode.streaming.changes import debounce, debounce_stream, flush, follow, quiet_paths, read_changes, with_flush
from gramlode.streaming.roots import root_batches

__all__ = [
    "FileCorpus", "Index", "SearchOutcome", "SyncStats", "TableCorpus", "apply_changes", "batch_errors",
    "build_index", "build_report", "build_totals", "candidates", "compact", "configure", "count_hits", "debounce",
    "debounce_stream", "document_count", "filter_paths", "flush", "foldable", "follow", "format_hits", "fresh_folder",
    "gram_document_frequency", "group_hits", "index_size", "index_status", "is_built", "json_array",
    "json_lines", "json_messages", "local_session", "open_index", "parse_root_specs", "quiet_paths", "read_changes", "read_roots",
    "resolve_roots", "root_batches", "scan_corpus", "search", "search_batch", "search_fresh", "search_summary",
    "shared_folder", "sync", "vacuum", "with_flush", "write_json", "write_json_array", "write_text",
]
