"""Whole texts of an Arrow column as arrays: bytes, words and 64-bit word hashes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODES = (np.random.default_rng(20240229).integers(1, 1 << 62, 256).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


class Words(NamedTuple):
    """Words of the documents first..last-1 of a batch."""

    first: int
    last: int
    doc: np.ndarray  # of each word, from 0 at ``first``
    hash: np.ndarray  # uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins and ends. Null is empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``most`` bytes, so that work arrays stay small; a longer text is a run alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _power(sign: int, n: int) -> np.ndarray:
    base = np.uint64(_BASE if sign > 0 else _BASE_INVERSE)
    if len(_powers[sign]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        steps = np.cumprod(steps, dtype=np.uint64)
        if n > SLICE_BYTES + 1:  # one huge word: not kept
            return steps
        _powers[sign] = steps
    return _powers[sign][:n]


def _pieces(text: np.ndarray, most: int = SLICE_BYTES) -> Iterator[np.ndarray]:
    """A long text cut at white space into parts of about ``most`` bytes; a longer word stays whole."""
    at = 0
    while at < len(text):
        end = min(at + most, len(text))
        while end < len(text) and not SPACE[text[end]]:  # the word goes on: to its end, a block at a time
            blank = np.flatnonzero(SPACE[text[end : end + 4096]])
            end = end + int(blank[0]) if len(blank) else min(end + 4096, len(text))
        yield text[at:end]
        at = end


def _hashes(part: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``part`` begins, and its hash; no word crosses the positions ``inner``."""
    n = len(part)
    solid = ~SPACE[part]
    begins, ends = np.empty(n + 1, bool), np.empty(n + 1, bool)
    begins[:n], begins[n] = solid, False
    begins[1:n] &= ~solid[:-1]
    ends[0], ends[1:] = False, solid
    ends[1:n] &= ~solid[1:]
    inner = inner[(inner > 0) & (inner < n)]
    crossing = inner[solid[inner] & solid[inner - 1]]
    begins[crossing] = ends[crossing] = True
    s, e = np.flatnonzero(begins), np.flatnonzero(ends)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[LOWER[part]] * _power(1, n), out=sums[1:])
    return s, mix((sums[e] - sums[s]) * _power(-1, n + 1)[s])


def words(data: np.ndarray, offsets: np.ndarray) -> Iterator[Words]:
    """Hashes of the words (runs of other bytes than space, tab to CR), A-Z lower-cased, of all documents.

    Work arrays cover a slice of ``SLICE_BYTES`` at a time, of long texts too; of a long text only its hashes are held.
    """
    none = np.empty(0, np.int64)
    for lo, hi in slices(offsets):
        part = data[offsets[lo] : offsets[hi]]
        if hi - lo == 1 and len(part) > SLICE_BYTES:
            h = np.concatenate([_hashes(piece, none)[1] for piece in _pieces(part)])
            yield Words(lo, hi, np.zeros(len(h), np.int64), h)
        else:
            bounds = offsets[lo : hi + 1] - offsets[lo]
            s, h = _hashes(part, bounds[1:-1])
            yield Words(lo, hi, np.searchsorted(bounds, s, "right") - 1, h)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of every run of ``size`` words; a document of fewer words is one shingle, of none has none."""
    n = len(w.hash)
    if not n:
        return w.doc, w.hash
    counts = np.bincount(w.doc, minlength=w.last - w.first)
    ends = np.cumsum(counts)
    left = ends[w.doc] - np.arange(n)  # words from this one to the end of its document
    h, ahead = np.zeros(n, np.uint64), np.append(w.hash, np.zeros(size, np.uint64))
    for k in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(left > k, ahead[k : k + n], np.uint64(k + 1))
    first = np.zeros(n, bool)
    first[(ends - counts)[counts > 0]] = True
    use = (left >= size) | first
    return w.doc[use], mix(h[use])
