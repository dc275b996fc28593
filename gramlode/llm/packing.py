"""Lexical retrieval packing: texts that share rare tokens share a training window.

Each text becomes ids and an end id. Its full windows are sequences of their own; what is left over (under
one window) is a *tail*. BM25 statistics (number of tails, their mean length, tails with a term) are those of all
tails. Tails meet in *shards* of at most ``shard``, in rounds. In each round a tail goes to the shard of its *key*: in the
first round its heaviest term that another tail has too, in the next the second heaviest. Shards are cut from the tails
in order of their keys by the counts of keys, so those of a frequent key fill several shards, and a shard may hold
many rare keys. An unused tail in turn is the seed of a window; the shard's index scores the others by all terms of the
seed and returns the unused ones by score, which fill the window greedily; the one that crosses its end is cut, and
the rest of it stays unused. Before the last round, a seed whose best neighbour does not have its key waits for the next
round, and so does what cannot fill a window. In the last round the next unused tails of the shard fill up when no
neighbour shares a term, and only the last window of a shard has padding.

A seed is compared with its shards only, not with all tails: exact retrieval takes a score of every tail with every
other, which grows with the square of the table.

Every id lies in exactly one piece. Null texts are empty: one end id. Rows are packed independently, so
repeated rows and repeated or null doc_ids are all kept. An empty table gives no pieces. Other columns are not
read. Where a key fills several shards, which of its tails meet depends on how the scan splits the table; the ids of a
document do not. BM25 terms are the ids of the whole tail, also for the rest of a cut one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import keep, rank_encoding, small_batches, token_sizes, vocabulary

RANKS = "byte_bpe_50k.tiktoken"  # the ids of byte_bpe_50k.json, from a faster library; a test compares both
WINDOW = 1024
END_ID = 0
SHARD_TAILS = 4096
ROUNDS = 2
FILL = 7 / 8  # of a shard by the counts of keys: a frequent key is dealt by a hash, not evenly
NEIGHBOURS = 64
FREQUENT, DENSE = 16, 1024  # terms in one of so many documents have dense rows, at most so many of them
SEEDS = 64
K1, B = 1.2, 0.75
STEPS = 256  # of a weight: a thousand weights below 64 add up exactly in 32-bit floats


LONG_TEXT = 1 << 20  # characters; such a text is encoded whole, without a table of its words
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, an end id after each, and where each text's begin (one more for the end).

    No match of the tokenizer's pattern goes on over a space that follows another character than white space, so texts are
    cut there, and each distinct word of the batch is encoded once, with the space before it.
    """
    encoding, texts = rank_encoding(path), pc.fill_null(texts, "").cast(pa.large_string())
    plain = pc.or_(pc.match_substring_regex(texts, SPACES + " "), pc.greater(pc.utf8_length(texts), LONG_TEXT))
    plain = plain.to_numpy(zero_copy_only=False)
    # a text that is encoded whole is one word
    pieces = pc.split_pattern(pc.if_else(pa.array(plain), "", texts), " ")
    first = pieces.offsets.to_numpy()
    coded = pieces.flatten().dictionary_encode()
    word, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    alone = pc.match_substring_regex(distinct, "^$|" + SPACES + "$").to_numpy(zero_copy_only=False)  # the next word's space would join them
    together = distinct.filter(pa.array(~alone))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(together)], pa.int32()), together), pa.scalar(" ", pa.large_string()))[0].as_py()
    ids = [encoding.encode_to_numpy(" " + joined if len(together) else "", disallowed_special=())]
    size = np.zeros(len(distinct), np.int64)
    # the bytes of ids tell which word they are of
    ends = np.cumsum(pc.binary_length(together).to_numpy() + 1)
    size[~alone] = np.diff(np.searchsorted(np.cumsum(token_sizes(path)[ids[0]]), ends, side="right"), prepend=0)
    start = np.cumsum(size) - size
    others = [" " + w for w in distinct.filter(pa.array(alone)).to_pylist()]
    whole = np.where(plain, texts.to_numpy(zero_copy_only=False), pieces.flatten().take(pa.array(first[:-1])).to_numpy(zero_copy_only=False))
    others = [encoding.encode_to_numpy(t, disallowed_special=()) for t in [*others, *whole.tolist()]] + [np.array([END_ID])]
    sizes = np.array([len(o) for o in others])
    starts = len(ids[0]) + np.cumsum(sizes) - sizes
    n = int(alone.sum())
    size[alone], start[alone] = sizes[:n], starts[:n]
    size, start = np.concatenate([size, sizes[n:]]), np.concatenate([start, starts[n:]])
    word[first[:-1]] = len(distinct) + np.arange(len(texts))
    word = np.insert(word, first[1:], len(size) - 1)
    ends = np.cumsum(size[word])
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[word] - ends + size[word], size[word])
    bounds = np.append(0, ends[first[1:] + np.arange(len(texts))])
    return np.concatenate([*ids, *others]).astype("<u4")[at], bounds


class Corpus:
    """The BM25 statistics of all documents: how many, their mean length, and how many have each term."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean, self.df = n, mean, df

    def weigh(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, weight) of the distinct terms of each document; weights in whole steps, so that sums are exact in any order."""
        sizes = np.array([len(d) for d in docs])
        terms = np.concatenate(docs).astype(np.int64)
        keys, tf = np.unique(np.repeat(np.arange(len(docs)), sizes) << 32 | terms, return_counts=True)
        doc, term = keys >> 32, keys & 0xFFFFFFFF
        idf = np.log1p((self.n - self.df[term] + 0.5) / (self.df[term] + 0.5))
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / self.mean))
        return doc, term, np.maximum(1, np.rint(weight * STEPS)).astype(np.float32)

    def keys(self, docs: list[np.ndarray], rounds: int) -> np.ndarray:
        """For each document a key for each round: its heaviest terms among those that others have too, the last such again where they are few."""
        doc, term, weight = self.weigh(docs)
        weight = np.where(self.df[term] > 1, weight, 0)
        start = np.searchsorted(doc, np.arange(len(docs)))
        keys, key = [], term[start]
        for _ in range(rounds):
            best = np.maximum.reduceat(weight, start)
            at = np.flatnonzero(weight == best[doc])
            first = at[np.searchsorted(doc[at], np.arange(len(docs)))]
            key = np.where(best > 0, term[first], key)
            weight[first] = 0
            keys.append(key)
        return np.stack(keys, 1)


def counted(docs: list[np.ndarray]) -> np.ndarray:
    """How many documents have each term."""
    return np.bincount(np.concatenate([np.unique(d) for d in docs])) if docs else np.zeros(0, np.int64)


class Bm25:
    """An inverted index over lists of ids: BM25 weights by term, dense rows for frequent terms, postings for the others."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        self.n = n = len(docs)
        corpus = corpus or Corpus(n, sum(map(len, docs)) / n, counted(docs))
        doc, term, weight = corpus.weigh(docs)
        self.terms, slot, df = np.unique(term, return_inverse=True, return_counts=True)
        often = df >= max(n / FREQUENT, np.sort(df)[-DENSE - 1] + 1 if len(df) > DENSE else 0)
        row, dense = np.cumsum(often) - 1, often[slot]
        self.dense = np.zeros((int(often.sum()), n), np.float32)
        self.dense[row[slot[dense]], doc[dense]] = weight[dense]
        self.ahead: dict[int, np.ndarray] = {}  # the dense part of the next seeds' scores
        slot, doc, weight = slot[~dense], doc[~dense], weight[~dense]
        self.query_slots, self.query_from = slot, np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(slot, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.start = np.searchsorted(slot[order], np.arange(len(self.terms) + 1))

    def scores(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Every document's score for all terms of the seed."""
        if seed not in self.ahead:
            seeds = np.append(seed, np.flatnonzero(unused[seed + 1 :])[: SEEDS - 1] + seed + 1)
            self.ahead = dict(zip(seeds.tolist(), (self.dense[:, seeds] > 0).T.astype(np.float32) @ self.dense, strict=True))
        scores = self.ahead[seed]
        slots = self.query_slots[slice(*self.query_from[seed : seed + 2])]
        lengths = self.start[slots + 1] - self.start[slots]
        total = int(lengths.sum())
        if total:
            at = np.repeat(self.start[slots] - np.cumsum(lengths) + lengths, lengths) + np.arange(total)
            scores = scores + np.bincount(self.docs[at], self.weights[at], self.n).astype(np.float32)
        return scores

    def neighbours(self, seed: int, unused: np.ndarray, most: int = NEIGHBOURS) -> np.ndarray:
        """Unused documents that share a term with the seed, best first, ties in order of the shard."""
        scores = np.where(unused, self.scores(seed, unused), 0)
        found = np.flatnonzero(scores)
        if len(found) > most:
            least = np.partition(scores[found], len(found) - most)[len(found) - most]
            found = found[scores[found] >= least]
        return found[np.lexsort((found, -scores[found]))][:most]


def fill_windows(
    tails: list[np.ndarray], window: int, begin: np.ndarray | None = None, corpus: Corpus | None = None, keys: np.ndarray | None = None
) -> Iterator[tuple[bool, list[tuple[int, int, int]]]]:
    """Windows as (True, list of (tail, from, length)); with ``keys``, also (False, list) of what waits for another round."""
    index = Bm25(tails, corpus)
    begin = np.zeros(len(tails), np.int64) if begin is None else begin.copy()
    left = np.array([len(t) for t in tails]) - begin
    unused = np.ones(len(tails), bool)
    for seed in range(len(tails)):
        while unused[seed]:
            placed, room = [], window
            if keys is not None:
                unused[seed] = False
                best = index.neighbours(seed, unused, 1)
                unused[seed] = True
                if not len(best) or keys[seed] not in tails[best[0]]:
                    break

            def put(tail: int, length: int):
                nonlocal room
                placed.append((tail, int(begin[tail]), length))
                begin[tail] += length
                left[tail] -= length
                unused[tail] = left[tail] > 0
                room -= length

            put(seed, int(left[seed]))
            while room and unused.any():
                found = index.neighbours(seed, unused)
                if not len(found):
                    following = np.flatnonzero(unused[seed:][: 4 * NEIGHBOURS]) + seed
                    found = following if len(following) else np.flatnonzero(unused)
                for tail in found:
                    put(int(tail), min(room, int(left[tail])))
                    if not room:
                        break
            yield keys is None or not room, placed
    for tail in np.flatnonzero(unused):
        yield False, [(int(tail), int(begin[tail]), int(left[tail]))]


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u4") for b in column.to_pylist()]


def statistics(tails: DataFrame) -> Corpus:
    """One job; a row for each term of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            docs = _ids(batch.column("ids"))
            more = counted(docs)
            df, more = (np.pad(c, (0, max(len(df), len(more)) - len(c))) for c in (df, more))
            df, n, length = df + more, n + len(docs), length + sum(map(len, docs))
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *has]), pa.array([length, n, *df[has]])], ["term", "docs"])

    rows = tails.select("ids").mapInArrow(run, "term bigint, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs")).toPandas()
    total = dict(zip(rows["term"].tolist(), rows["docs"].tolist(), strict=True))
    length, n = total.pop(-2, 0), total.pop(-1, 0)
    df = np.zeros(max(total, default=0) + 1, np.int64)
    df[list(total)] = list(total.values())
    return Corpus(n, length / max(n, 1), df)


def _places(keyed: DataFrame, nth: int) -> DataFrame:
    """(key, place, of): where the tails of each key begin in the order of keys, and how many they are; at most the vocabulary."""
    counts = sorted(map(tuple, keyed.groupBy(F.col("keys")[nth]).count().collect()))
    ends = np.cumsum([n for _, n in counts])
    rows = [(k, int(e) - n, n) for (k, n), e in zip(counts, ends.tolist(), strict=True)]
    return keyed.sparkSession.createDataFrame(rows, "key bigint, place bigint, of bigint")


def dealt(tails: DataFrame, corpus: Corpus, nth: int, shard: int) -> DataFrame:
    """The tails with keys and shard, those of a shard together, in order of doc_id and start."""
    if nth == 0:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    keys = corpus.keys(_ids(batch.column("ids")), ROUNDS)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), ROUNDS).cast(pa.list_(pa.int64()))
                    others = [n for n in batch.schema.names if n != "keys"]
                    yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), lists], [*others, "keys"])

        # twice: counting reads the ids alone, and keys are cheaper to find again than to write
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tails.schema)
        places = _places(tails.select("ids").mapInArrow(run, "ids binary, keys array<bigint>"), nth)
        tails = tails.mapInArrow(run, schema)
    else:
        places = _places(tails, nth)
    span = max(1, int(shard * FILL))
    keyed = tails.withColumn("key", F.col("keys")[nth])
    at = F.col("place") + F.pmod(F.xxhash64("doc_id", "start", "begin"), F.col("of"))
    placed = keyed.join(F.broadcast(places), "key").withColumn("shard", F.floor(at / span)).drop("place", "of")
    return placed.repartition("shard").sortWithinPartitions("shard", "doc_id", "start", "begin", "sequence_id")


def pack(docs: DataFrame, ranks: str | None = None, window: int = WINDOW, shard: int = SHARD_TAILS) -> DataFrame:
    """Pieces: (doc_id, start, ids binary, length, ids_crc32, doc_tokens, sequence_id, offset); ids little-endian unsigned 32 bits."""
    path = ranks or vocabulary(RANKS)
    small_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "piece", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "begin", "ids", "keys"]
    # a piece has its ids in ``piece``; a tail that waits has them in ``ids``, a begin, and a number of its own for sequence_id
    schema = f"doc_id {key}, start bigint, piece binary, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    schema += "offset bigint, begin bigint, ids binary, keys array<bigint>"
    whole = pa.int64()
    kinds = [whole, pa.binary(), whole, whole, whole, whole, whole, whole, pa.binary(), pa.list_(whole)]

    def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds], strict=True)], names)

    def placed(doc_id, start: int, ids: np.ndarray, doc_tokens: int, sequence: int, offset: int) -> tuple:
        piece = ids.tobytes()
        return doc_id, start, piece, len(ids), zlib.crc32(piece), doc_tokens, sequence, offset, None, None, None

    def waiting(doc_id, start: int, ids: bytes, doc_tokens: int, number: int, begin: int, keys: list[int] | None) -> tuple:
        return doc_id, start, None, None, None, doc_tokens, number, None, begin, ids, keys

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            found, bounds = encode(batch.column("text"), path)
            for doc_id, lo, hi in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                ids = found[lo:hi]
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    if len(piece) == window:
                        rows.append(placed(doc_id, start, piece, len(ids), sequence, 0))
                    else:
                        rows.append(waiting(doc_id, start, piece.tobytes(), len(ids), sequence, 0, None))
                    sequence += 1
            yield made(rows, batch.schema.field("doc_id").type)

    def packed(corpus: Corpus, nth: int):
        last = nth == ROUNDS - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sequence = (TaskContext.get().partitionId() << 33) + (nth + 1 << 31)
            tails: list[dict] = []
            kind = None

            def windows() -> pa.RecordBatch:
                nonlocal sequence
                rows, ids = [], [np.frombuffer(t["ids"], "<u4") for t in tails]
                begins, keys = (np.array([t[c] for t in tails]) for c in ("begin", "key"))
                for full, pieces in fill_windows(ids, window, begins, corpus, None if last else keys):
                    offset = 0
                    for tail, begin, length in pieces:
                        t = tails[tail]
                        if full:
                            rows.append(placed(t["doc_id"], t["start"] + begin, ids[tail][begin : begin + length], t["doc_tokens"], sequence, offset))
                        else:
                            rows.append(waiting(t["doc_id"], t["start"], t["ids"], t["doc_tokens"], t["sequence_id"], begin, t["keys"]))
                        offset += length
                    sequence += full
                tails.clear()
                return made(rows, kind)

            for batch in batches:
                kind = batch.schema.field("doc_id").type
                for tail in batch.to_pylist():
                    if tails and (len(tails) == shard or tails[0]["shard"] != tail["shard"]):
                        yield windows()
                    tails.append(tail)
            if tails:
                yield windows()

        return run

    def taken(table: DataFrame) -> DataFrame:
        return table.where("begin is null").select("doc_id", "start", F.col("piece").alias("ids"), *names[3:8])

    def left(table: DataFrame) -> DataFrame:  # the ids of full windows are in another column, so they are not read
        return table.where("begin is not null").select("doc_id", "start", "doc_tokens", "sequence_id", "begin", "ids", "keys")

    now = keep(docs.select("doc_id", "text").mapInArrow(cut, schema), "packing")
    pieces = taken(now)
    corpus = statistics(left(now))
    for nth in range(ROUNDS):
        now = keep(dealt(left(now), corpus, nth, shard).mapInArrow(packed(corpus, nth), schema), "packing")
        pieces = pieces.unionByName(taken(now))
    return pieces


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces without their ids."""
    return pieces.drop("ids").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
