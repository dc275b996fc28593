"""Quality scores by Bradley-Terry pairwise ranking.

A document's features are the rates of neighbouring byte classes (letters, capitals, digits, each kind of
punctuation, ...) and of a few shapes (word and line lengths, repeats). ``fit`` forms preference pairs, each
a document of label 1 preferred to one of label 0, and learns weights by the logistic loss on the difference
of their features: P(i before j) = 1 / (1 + exp(-w (x_i - x_j))). The threshold is the quantile of the fitted
documents' scores that separates the labels best; ``score`` puts it at 0.5.

The fit reads at most ``fit_rows`` labelled rows (those first by a hash of doc_id, so the choice does not
depend on the order of rows); scores are given to every row and read the whole text. A null text is empty; an empty
text has a score. Labels that are null, neither 0 nor 1, or without a document are passed over; where one
label is missing altogether, every score is 0.5. Rows are scored alone, so ties and repeated rows keep equal
scores. Only doc_id and text are read from the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import small_batches
from gramlode.llm.words import SLICE_BYTES, slices, text_bytes, words

FIT_ROWS = 6000
PAIRS_PER_ROW = 8
STEPS = 300
L2 = 1e-3

CLASSES = np.zeros(256, np.int64)
CLASSES[0x80:0xC0], CLASSES[0xC0:] = 1, 2  # UTF-8: following and first bytes
CLASSES[ord("a") : ord("z") + 1] = 3
CLASSES[ord("A") : ord("Z") + 1] = 4
CLASSES[ord("0") : ord("9") + 1] = 5
for _k, _c in enumerate(sorted({*range(0x20, 0x7F)} - {ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"})):
    CLASSES[_c] = 6 + _k
CLASSES[0x0A] = 39
N_CLASSES = 40
N_SHAPES = 5
WIDTH = N_CLASSES * N_CLASSES + N_SHAPES


class Ranker(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Between 0 and 1; 0.5 at the threshold."""
        s = (features - self.mean) / self.scale @ self.weights
        return 1 / (1 + np.exp(-np.clip((s - self.threshold) / self.spread, -30, 30)))


def _long_text(out: np.ndarray, text: np.ndarray) -> None:
    """The byte features of one long text, counted a slice at a time."""
    pairs, counts, lines = N_CLASSES * N_CLASSES, np.zeros(N_CLASSES * N_CLASSES, np.int64), 0
    for at in range(0, len(text), SLICE_BYTES):
        kind = CLASSES[text[at : at + SLICE_BYTES + 1]]  # pairs overlap by one byte
        counts += np.bincount(kind[:-1] * N_CLASSES + kind[1:], minlength=pairs)
        lines += int((kind[:SLICE_BYTES] == 39).sum())
    out[:pairs] = np.sqrt(counts / len(text))
    out[pairs], out[pairs + 1] = np.log1p(len(text)), np.log1p(lines)


def features_of(column: pa.Array) -> np.ndarray:
    """One row of features for each text."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(column), WIDTH), np.float32)
    pairs = N_CLASSES * N_CLASSES
    for lo, hi in slices(offsets):
        if hi - lo == 1 and offsets[hi] - offsets[lo] > SLICE_BYTES:
            _long_text(out[lo], data[offsets[lo] : offsets[hi]])
            continue
        part = data[offsets[lo] : offsets[hi]]
        sizes = np.diff(offsets[lo : hi + 1])
        kind = CLASSES[part]
        doc = np.repeat(np.arange(hi - lo), sizes)
        same = doc[1:] == doc[:-1]
        cell = (doc[:-1] * pairs + kind[:-1] * N_CLASSES + kind[1:])[same]
        counts = np.bincount(cell, minlength=(hi - lo) * pairs).reshape(hi - lo, pairs)
        out[lo:hi, :pairs] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
        out[lo:hi, pairs] = np.log1p(sizes)
        out[lo:hi, pairs + 1] = np.log1p(np.bincount(doc[kind == 39], minlength=hi - lo))
    for w in words(data, offsets):
        n = w.last - w.first
        count = np.bincount(w.doc, minlength=n)
        order = np.lexsort((w.hash, w.doc))
        d, h = w.doc[order], w.hash[order]
        new = np.ones(len(h), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        size = np.diff(offsets[w.first : w.last + 1])
        out[w.first : w.last, pairs + 2] = np.bincount(d[new], minlength=n) / np.maximum(count, 1)
        out[w.first : w.last, pairs + 3] = size / np.maximum(count, 1)
        out[w.first : w.last, pairs + 4] = np.log1p(count)
    return out


def learn(x: np.ndarray, label: np.ndarray, seed: int = 0) -> Ranker:
    """Fit weights to preference pairs by gradient steps, then the threshold to a quantile of the scores.

    ``x`` is standardised in place: the driver holds one copy of it.
    """
    if not ((label == 1).any() and (label == 0).any()):
        return Ranker(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), np.zeros(WIDTH, np.float32), 0.0, 1.0)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = x
    z -= mean
    z /= scale
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    i = np.concatenate([np.repeat(good, PAIRS_PER_ROW), rng.choice(good, len(bad) * PAIRS_PER_ROW)])
    j = np.concatenate([rng.choice(bad, len(good) * PAIRS_PER_ROW), np.repeat(bad, PAIRS_PER_ROW)])
    w, momentum, square = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH)
    for step in range(1, STEPS + 1):
        s = z @ w
        pull = 1 / (1 + np.exp(np.clip(s[i] - s[j], -30, 30)))
        each = np.bincount(i, pull, len(z)) - np.bincount(j, pull, len(z))
        g = L2 * w - each.astype(np.float32) @ z / len(i)
        momentum, square = 0.9 * momentum + 0.1 * g, 0.999 * square + 0.001 * g * g
        w = w - 0.02 * (momentum / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    s = z @ w
    levels = np.unique(np.quantile(s, np.linspace(0, 1, 401)))
    middle = (levels[1:] + levels[:-1]) / 2 if len(levels) > 1 else levels
    right = [((s[good] >= t).mean() + (s[bad] < t).mean()) for t in middle]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    return Ranker(mean, scale, w.astype(np.float32), float(middle[best[len(best) // 2]]), float(s.std() / 4 + 1e-6))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None,
        fit_rows: int = FIT_ROWS) -> Ranker:
    """Learn from the rows of ``labels`` (doc_id, ``label``) that ``usable`` admits, ``fit_rows`` at most."""
    small_batches(docs.sparkSession)
    chosen = labels.where(usable) if usable is not None else labels
    chosen = (
        chosen.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for r in features_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.binary())], ["label", "features"])

    # both sides of the join and its result are bounded by fit_rows, unless doc_ids repeat
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .orderBy(F.xxhash64("doc_id", "text"), "label").limit(fit_rows)
        .select("label", "text").mapInArrow(run, "label int, features binary").toArrow()
    )
    x, y = np.empty((rows.num_rows, WIDTH), np.float32), rows.column("label").to_numpy()
    at = 0
    for chunk in rows.column("features").chunks:
        for value in chunk:
            x[at] = np.frombuffer(value.as_buffer(), np.float32)
            at += 1
    del rows
    return learn(x, y)


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """All columns of ``docs`` but any of the same name, and score (double) and predicted (int)."""
    small_batches(docs.sparkSession)
    kept = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = ranker.scores(features_of(batch.column("text"))).astype(np.float64)
            yield batch.append_column("score", pa.array(s)).append_column("predicted", pa.array((s >= 0.5).astype(np.int32)))

    fields = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return kept.mapInArrow(run, f"{fields}, score double, predicted int")


def good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are predicted to be of label 1. Texts travel to Python once."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(ranker.scores(features_of(batch.column("text"))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
