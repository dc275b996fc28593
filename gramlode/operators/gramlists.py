"""Grams and posting lists on Arrow batches, inside tasks: codes and offsets instead of a row for each gram of a text.

Spark deals out the texts and shuffles the lists; a task holds one batch of texts, or ``PAIRS_HELD`` (document, gram) pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from gramlode.constants import ASCII_LOWER, ASCII_UPPER, FOLDING_TO_ASCII

PAIRS_HELD = 4_000_000          # pairs whose lists are made at once
FLAGS_HELD = 32_000_000         # (text, gram) flags at once
SLICE_CHARS = 1_000_000         # longer texts are cut into overlapping slices
_NO_THIRD = (1 << 21) - 1       # beyond every code point: the third place of a pair
_FOLD = [(ord(a), ord(b)) for a, b in FOLDING_TO_ASCII.items()]


def _code_points(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points[(points >= ord(ASCII_UPPER[0])) & (points <= ord(ASCII_UPPER[-1]))] += ord(ASCII_LOWER[0]) - ord(ASCII_UPPER[0])
    for source, target in _FOLD:
        points[points == source] = target
    return points


def _distinct(places: np.ndarray, codes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (place, code), in order of place; places are in order and below ``rows``."""
    encoded = pa.array(codes).dictionary_encode()
    names, at = encoded.dictionary.to_numpy(), encoded.indices.to_numpy()
    step = max(1, FLAGS_HELD // max(1, len(names)))
    found = []
    for first in range(0, rows, step):
        a, b = np.searchsorted(places, [first, first + step])
        flags = np.zeros((min(step, rows - first), len(names)), bool)
        flags[places[a:b] - first, at[a:b]] = True
        place, code = np.nonzero(flags)
        found.append((place + first, names[code]))
    return np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found])


def _gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of the distinct grams of texts, in order of text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = _code_points("".join(texts))
    place, ends = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))          # characters from here to the end of the text
    three = np.flatnonzero(left >= 3)
    codes = (points[three] << 42) | (points[three + 1] << 21) | points[three + 2]
    at, codes = _distinct(place[three], codes, len(texts))
    last = np.flatnonzero(left == 2)                                # other pairs are the head of three
    pair_at, pairs = np.concatenate([at, place[last]]), np.concatenate([codes | _NO_THIRD, (points[last] << 42) | (points[last + 1] << 21) | _NO_THIRD])
    order = np.argsort(pair_at, kind="stable")
    pair_at, pairs = _distinct(pair_at[order], pairs[order], len(texts))
    at, codes = np.concatenate([at, pair_at]), np.concatenate([codes, pairs])
    order = np.argsort(at, kind="stable")
    return at[order], codes[order]


def _sliced(text: str) -> np.ndarray:
    """Codes of a long text, a slice at a time."""
    codes = np.zeros(0, np.int64)
    for first in range(0, max(1, len(text) - 2), SLICE_CHARS):
        codes = np.union1d(codes, _gram_codes([text[first : first + SLICE_CHARS + 2]])[1])
    return codes


def _spelled(codes: np.ndarray) -> pa.Array:
    """Codes as strings, each distinct one spelled once."""
    encoded = pa.array(codes).dictionary_encode()
    names = encoded.dictionary.to_numpy()
    third = names & _NO_THIRD
    short = third == _NO_THIRD
    points = np.stack([names >> 42, (names >> 21) & _NO_THIRD, np.where(short, 0, third)], axis=1).astype("<u4")
    chars = points.tobytes().decode("utf-32-le", "surrogatepass")
    grams = [chars[3 * k : 3 * k + (2 if s else 3)] for k, s in enumerate(short.tolist())]
    return pa.array(grams, pa.string()).take(encoded.indices)


def gram_arrays(texts: list[str | None]) -> pa.Array:
    """list<string>: the grams of each text, as ``distinct_ngrams`` has them, in any order; null for null."""
    held = [t if t is not None and len(t) <= SLICE_CHARS else "" for t in texts]
    parts, first, chars = [], 0, 0
    for k, text in enumerate(held):     # slices of a batch, so that codes stay few
        chars += len(text)
        if chars >= SLICE_CHARS or k == len(held) - 1:
            at, codes = _gram_codes(held[first : k + 1])
            parts.append((at + first, codes))
            first, chars = k + 1, 0
    for k, text in enumerate(texts):
        if text is not None and len(text) > SLICE_CHARS:
            codes = _sliced(text)
            parts.append((np.full(len(codes), k), codes))
    at = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.int64)
    codes = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(at, kind="stable")
    offsets = np.searchsorted(at[order], np.arange(len(texts) + 1))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _spelled(codes[order]))
    if all(t is not None for t in texts):
        return lists
    return pa.array([v if t is not None else None for v, t in zip(lists.to_pylist(), texts, strict=True)], pa.list_(pa.string()))


def decoded(column: pa.Array) -> list[str | None]:
    """A string column as Python strings; bytes that are no UTF-8 become U+FFFD."""
    return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def with_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a column ``grams`` added, from ``text``."""
    for batch in batches:
        if batch.num_rows:
            grams = gram_arrays(decoded(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, grams], [*batch.schema.names, "grams"])


def posting_lists(block_bits: int):
    """A function from batches of (doc, grams) to batches of (gram, block, docs): lists of a task's documents, as their low 16 bits.

    A gram and block has a row for each time the task has held ``PAIRS_HELD`` pairs, not one for each document.
    """

    def made(names: dict[str, int], held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        docs, sizes, keys = (np.concatenate(part) for part in zip(*held, strict=True))
        blocks, block = np.unique(docs >> block_bits, return_inverse=True)
        keys = keys * len(blocks) + np.repeat(block, sizes)
        low = np.repeat((docs & ((1 << block_bits) - 1)).astype(np.uint16), sizes)
        order = np.argsort(keys, kind="stable")
        keys, low = keys[order], low[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), pa.array(low.view(np.int16)))
        grams = pa.array(list(names), pa.string()).take(pa.array(keys[starts] // len(blocks)))
        return pa.RecordBatch.from_arrays([grams, pa.array(blocks[keys[starts] % len(blocks)], pa.int64()), lists], ["gram", "block", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held, pairs = [], 0
        for batch in batches:
            lists = batch.column("grams")
            encoded = lists.flatten().dictionary_encode()
            if len(encoded):
                own = np.array([names.setdefault(g, len(names)) for g in encoded.dictionary.to_pylist()], np.int64)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((batch.column("doc").to_numpy(), sizes, own[encoded.indices.to_numpy()]))
                pairs += len(encoded)
            if pairs >= PAIRS_HELD:
                yield made(names, held)
                names, held, pairs = {}, [], 0
        if held:
            yield made(names, held)

    return run
