"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of n-grams, from the whole word history of ``order - 1`` words down to
single words, and a uniform share:

    P(w | h) = l_n c(h w)/c(h) + ... + l_1 c(w)/N + l_0 1/(V + 1)

The weights l depend on the bucket of c(h), in octaves. They are learned by expectation-maximisation on
held-out counts: each training token in turn is deleted from the counts, and the estimates without it predict it.
Probabilities enter the maximisation rounded to an eighth of an octave, as counts of (bucket, probabilities) cells
over all training tokens; scores use exact ones.

How it runs: tasks cut the texts they scan into *batches* of about ``BATCH_BYTES``, a row each: the batch's distinct
words and its tokens as indices. Each batch asks for the counts of its distinct n-grams, pre-aggregated; the questions are
shuffled by n-gram, so a word that makes up a third of all text is asked for once by a batch at most; the answers come back
by batch. All counts cover all training texts; nothing is broadcast but weights. N-grams are told apart by 64-bit hashes.

Tokens are the words [^\\x20\\x09-\\x0D]+, A-Z lower-cased, then one end token. Null texts are empty: one token. Every
row gives a row, so repeated rows and repeated or null doc_ids stay. Without training texts all scores are 0. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import keep, small_batches
from gramlode.llm.words import mix, text_bytes, words

ORDER = 2
BATCH_BYTES = 8 << 20
SHARD_TOKENS = 1 << 20
STEPS_PER_OCTAVE = 8
EM_ROUNDS = 60
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed bytes: neighbouring differences, by byte planes."""
    import zstandard

    v = np.ascontiguousarray(values)
    planes = v.view(np.uint8).reshape(len(v), v.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def sorted_bytes(grams: np.ndarray) -> bytes:
    """Sorted uint64."""
    return squeeze(np.diff(grams, prepend=np.uint64(0)))


def from_sorted_bytes(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


def batches_of(docs: DataFrame, fit: Column, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row for each batch: docs (ids), fit, sizes (tokens of each document), words (sorted), tokens (indices)."""
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", F.coalesce(fit, F.lit(False)).alias("fit"), "text")
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, fits, sizes, hashes, held, kind = [], [], [], [], 0, None

        def made() -> pa.RecordBatch:
            nonlocal held
            vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            columns = [
                pa.array([sum(ids, [])], pa.list_(kind)), pa.array([np.packbits(np.concatenate(fits)).tobytes()]),
                pa.array([squeeze(np.concatenate(sizes))]), pa.array([sorted_bytes(vocabulary)]),
                pa.array([squeeze(tokens.astype(np.int32))]), pa.array([len(tokens)], pa.int64()),
            ]
            for x in (ids, fits, sizes, hashes):
                x.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, ["docs", "fit", "sizes", "words", "tokens", "n_tokens"])

        for batch in arrow:
            kind = batch.schema.field("doc_id").type
            data, offsets = text_bytes(batch.column("text"))
            all_ids, all_fit = batch.column("doc_id").to_pylist(), batch.column("fit").to_numpy(zero_copy_only=False)
            for w in words(data, offsets):
                n = w.last - w.first
                size = np.bincount(w.doc, minlength=n)
                tokens = np.insert(w.hash, np.cumsum(size), END)
                ids.append(all_ids[w.first : w.last])
                fits.append(all_fit[w.first : w.last])
                sizes.append((size + 1).astype(np.int32))
                hashes.append(tokens)
                held += int(offsets[w.last] - offsets[w.first]) + n
                if held >= batch_bytes:
                    yield made()
        if ids:
            yield made()

    out = source.mapInArrow(run, f"docs array<{key}>, fit binary, sizes binary, words binary, tokens binary, n_tokens bigint")
    return out.withColumn("batch", F.monotonically_increasing_id())


class Batch:
    """A batch opened: its tokens, and the distinct n-grams of each order with the tokens that end them."""

    def __init__(self, row: dict, order: int):
        self.ids, self.sizes = row["docs"], unsqueeze(row["sizes"], np.int32).astype(np.int64)
        self.fit = np.unpackbits(np.frombuffer(row["fit"], np.uint8), count=len(self.sizes)).astype(bool)
        vocabulary, tokens = from_sorted_bytes(row["words"]), unsqueeze(row["tokens"], np.int32)
        self.first = np.zeros(len(tokens), bool)  # of its document
        self.first[np.cumsum(self.sizes) - self.sizes] = True
        self.token_fit = np.repeat(self.fit, self.sizes)
        self.grams, self.at = [vocabulary], [tokens]
        h = longest = vocabulary[tokens]
        for k in range(1, order):
            before = np.empty_like(longest)
            before[1:] = longest[:-1]
            before[self.first] = START if k == 1 else mix(np.array([START + np.uint64(k)]))[0]
            longest = mix(before * _FACTOR + h + np.uint64(k))
            grams, at = np.unique(longest, return_inverse=True)
            self.grams.append(grams)
            self.at.append(at)

    def fit_counts(self, k: int) -> np.ndarray:
        return np.bincount(self.at[k], self.token_fit, len(self.grams[k])).astype(np.int64)


def shard_bounds(grams: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in sorted grams, and their end; a shard is a range of hashes."""
    edges = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def counted(batches: DataFrame, shards: int, order: int = ORDER) -> DataFrame:
    """(batch, kind, shard, counts): training counts of the batch's n-grams, in its own order.

    Rows of kind -1 hold, for a shard, the tokens, the distinct words and the documents of the training texts.
    """

    def ask(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in arrow:
            for row in _rows(record):
                b = Batch(row, order)
                out = []
                for k in range(order):
                    n, bounds = b.fit_counts(k), shard_bounds(b.grams[k], shards)
                    for s in np.flatnonzero(np.diff(bounds)):
                        part = slice(bounds[s], bounds[s + 1])
                        out.append((int(s), row["batch"], k, sorted_bytes(b.grams[k][part]), squeeze(n[part].astype(np.int32))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                    ["shard", "batch", "kind", "grams", "n"],
                )

    def answer(table: pa.Table) -> pa.Table:
        """All lists of a shard and order: added up, and each list's totals handed back."""
        shard, k = table.column("shard")[0].as_py(), table.column("kind")[0].as_py()
        batch, sizes, asked, given = table.column("batch").to_pylist(), [], [], []
        for grams, n in zip(table.column("grams"), table.column("n"), strict=True):
            asked.append(from_sorted_bytes(grams.as_py()))
            given.append(unsqueeze(n.as_py(), np.int32))
            sizes.append(len(asked[-1]))
        grams, at = np.unique(np.concatenate(asked), return_inverse=True)
        asked.clear()
        n = np.bincount(at, np.concatenate(given), len(grams)).astype(np.int64)  # exact below 2^53
        out = []
        if k == 0:
            out.append((-1, -1, shard, squeeze(np.array([n.sum(), (n > 0).sum(), n[grams == END].sum()], np.int64))))
        ends = np.cumsum(sizes)
        for number, lo, hi in zip(batch, [0, *ends[:-1]], ends, strict=True):
            out.append((number, k, shard, squeeze(n[at[lo:hi]])))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["batch", "kind", "shard", "counts"])

    asked = batches.mapInArrow(ask, "shard int, batch bigint, kind int, grams binary, n binary")
    return asked.groupBy("shard", "kind").applyInArrow(answer, "batch bigint, kind int, shard int, counts binary")


class Model(NamedTuple):
    order: int
    n: int  # training tokens
    v: int  # distinct ones
    documents: int
    weights: np.ndarray  # buckets x (order + 1): uniform, words, ..., longest

    def bucket(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, np.log2(np.maximum(c, 1)).astype(np.int64) + 1, 0)


def _counts(b: Batch, answers: list[dict], documents: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each token: counts of the n-grams that end there, by order, and of the contexts before them."""
    grams, contexts = [], []
    for k in range(len(b.grams)):
        own = sorted((a for a in answers if a["kind"] == k), key=lambda a: a["shard"])
        grams.append(np.concatenate([unsqueeze(a["counts"], np.int64) for a in own])[b.at[k]])
        if k:
            before = np.empty_like(grams[k - 1])
            before[1:] = grams[k - 1][:-1]
            before[b.first] = documents
            contexts.append(before)
    return grams, contexts


def _estimates(grams, contexts, n: int, v: int, less: int) -> list[np.ndarray]:
    """Uniform share, word share, ..., with ``less`` occurrences of each token deleted."""
    out = [np.full(len(grams[0]), 1 / (v + 1)), (grams[0] - less) / max(1, n - less)]
    for g, c in zip(grams[1:], contexts, strict=True):
        out.append(np.where(c > less, (g - less) / np.maximum(c - less, 1), 0.0))
    return out


def _with_answers(batches: DataFrame, answers: DataFrame) -> DataFrame:
    own = answers.where("kind >= 0").groupBy("batch").agg(F.collect_list(F.struct("kind", "shard", "counts")).alias("answers"))
    return batches.join(own, "batch")


def learn(batches: DataFrame, answers: DataFrame, order: int = ORDER) -> Model:
    """Totals, and weights by expectation-maximisation over all training tokens."""
    n = v = documents = 0
    for row in answers.where("kind = -1").select("counts").toLocalIterator():  # three numbers for each shard
        a, b, c = unsqueeze(row["counts"], np.int64).tolist()
        n, v, documents = n + a, v + b, documents + c
    buckets = max(n, documents).bit_length() + 1  # one for each octave that a count can have
    flat = Model(order, n, v, documents, np.zeros((buckets, order + 1)))

    def cells(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in arrow:
            for row in _rows(record):
                b = Batch(row, order)
                grams, contexts = _counts(b, row["answers"], documents)
                use = b.token_fit
                grams, contexts = [g[use] for g in grams], [c[use] for c in contexts]
                cell = flat.bucket(contexts[-1] - 1) if contexts else np.zeros(len(grams[0]), np.int64)
                for p in _estimates(grams, contexts, n, v, 1)[1:]:
                    octave = np.where(p > 0, np.round(-STEPS_PER_OCTAVE * np.log2(np.where(p > 0, p, 1))) + 1, 0)
                    cell = cell * 512 + np.minimum(octave, 511).astype(np.int64)
                cell, times = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(times.astype(np.int64))], ["cell", "times"])

    # the cells are bounded by octaves x 512 ^ order, not by the corpus
    found = _with_answers(batches, answers).mapInArrow(cells, "cell bigint, times bigint").groupBy("cell").agg(F.sum("times").alias("times")).toArrow()
    cell, times = found.column("cell").to_numpy(), found.column("times").to_numpy().astype(float)
    order_by = np.argsort(cell)
    return flat._replace(weights=weights_of(cell[order_by], times[order_by], order, v, buckets))


def weights_of(cell: np.ndarray, times: np.ndarray, order: int, v: int, buckets: int) -> np.ndarray:
    """Mixture weights of each bucket by expectation-maximisation, drawn to those of all buckets where data is little."""
    p = np.empty((len(cell), order + 1))
    for k in range(order, 0, -1):
        step = cell % 512
        p[:, k] = np.where(step > 0, 2.0 ** (-(step - 1) / STEPS_PER_OCTAVE), 0.0)
        cell = cell // 512
    p[:, 0] = 1 / (v + 1)

    def fitted(rows: np.ndarray, start: np.ndarray, prior: float) -> np.ndarray:
        w = start
        for _ in range(EM_ROUNDS):
            share = p[rows] * w
            share *= (times[rows] / share.sum(1))[:, None]
            w = share.sum(0) + prior * start
            w /= w.sum()
        return w

    every = np.full(order + 1, 1 / (order + 1))
    if len(cell):
        every = fitted(np.arange(len(cell)), every, 1e-9)
    else:
        every = np.eye(order + 1)[0]
    out = np.tile(every, (buckets, 1))
    for b in range(buckets):
        rows = np.flatnonzero(cell == b)
        if len(rows):
            out[b] = fitted(rows, every, 5.0)
    if order > 1:  # a context never seen has no estimate
        out[0, order] = 0
        out[0] /= max(out[0].sum(), 1e-300)
    return np.maximum(out, 1e-12)


def scored(batches: DataFrame, answers: DataFrame, model: Model, key: str = "bigint") -> DataFrame:
    """(doc_id, fit, n_tokens, n_known, base_score, score) of every document."""
    m = model

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in arrow:
            kind = record.schema.field("docs").type.value_type
            for row in _rows(record):
                b = Batch(row, m.order)
                grams, contexts = _counts(b, row["answers"], m.documents)
                w = m.weights[m.bucket(contexts[-1])] if contexts else np.broadcast_to(m.weights[-1], (len(grams[0]), 2))
                p = sum(w[:, k] * e for k, e in enumerate(_estimates(grams, contexts, m.n, m.v, 0)))
                base = np.log10((grams[0] + 1) / (m.n + m.v + 1))
                at = np.cumsum(b.sizes) - b.sizes
                add = lambda x: np.add.reduceat(x, at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.ids, kind), pa.array(b.fit), pa.array(b.sizes), pa.array(add((grams[0] > 0).astype(np.int64))),
                     pa.array(add(base)), pa.array(add(np.log10(p)))],
                    ["doc_id", "fit", "n_tokens", "n_known", "base_score", "score"],
                )

    schema = f"doc_id {key}, fit boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    return _with_answers(batches, answers).mapInArrow(run, schema)


def score(docs: DataFrame, fit: Column, order: int = ORDER, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``scored`` for every row of ``docs``, learned from those where ``fit`` holds; train_tokens too."""
    batches = keep(batches_of(docs, fit, batch_bytes), "lm-batches")
    tokens = batches.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // SHARD_TOKENS))
    answers = keep(counted(batches, shards, order), "lm-counts")
    model = learn(batches, answers, order)
    return scored(batches, answers, model, docs.schema["doc_id"].dataType.simpleString()).withColumn("train_tokens", F.lit(model.n))
