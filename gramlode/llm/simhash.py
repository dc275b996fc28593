"""SimHash fingerprints of whole texts, and all fingerprints within a Hamming radius.

The terms of a text are its five-word shingles; a term's weight is how often it occurs. Each bit of the 128-bit
hash of a term votes for or against that bit of the fingerprint with the term's weight. *Likeness* of two
fingerprints is the share of equal bits.

``neighbours`` finds fingerprints within ``radius`` bits by permuted block tables: the 32 hex digits are cut into
``blocks`` blocks; two fingerprints that differ in at most ``radius`` bits agree in at least ``blocks - radius`` of them,
so there is one table for each choice of so many blocks, and candidates share a table's key. Equal fingerprints are one
entry. Small groups of a key are compared by a join, large ones in blocks within tasks, which
emit a count for each member only. Pairs that meet in several tables count in the first one.

``edited`` compares each text with an edit of it: its last quarter replaced by the beginning of the next document
(ascending doc_id, null first; rows with the same doc_id in order of a hash of their texts; after the last the first). Texts are
dealt by ranges in that order once; only each range's first and last row meet others. A single row follows itself.

Null texts are empty. A text without words has the fingerprint of all zeros. Repeated rows keep their rows; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramlode.llm.common import keep, small_batches
from gramlode.llm.words import mix, shingles, text_bytes, words

WORDS = 5
BITS = 128
DIGITS = BITS // 4
RADIUS, BLOCKS = 6, 8
TERMS = 1 << 16
SMALL_GROUP, BLOCK_ROWS = 16, 8192
_LANES = np.array([sum(((b >> (7 - k)) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
_MOST = 255  # votes that a lane of 8 bits holds


def _vote(votes: np.ndarray, doc: np.ndarray, h: np.ndarray) -> None:
    """Add the set bits of the terms' hashes to the votes of their documents."""
    count = np.bincount(doc, minlength=len(votes))
    raw = np.stack([h, mix(h ^ np.uint64(0x9E3779B97F4A7C15))], 1).byteswap().view(np.uint8)
    lanes = _LANES[raw]
    full = np.flatnonzero(count)
    start = (np.cumsum(count) - count)[full]
    runs = -(-count[full] // _MOST)
    first = np.cumsum(runs) - runs
    at = np.repeat(start, runs) + _MOST * (np.arange(runs.sum()) - np.repeat(first, runs))
    partial = np.add.reduceat(lanes, at, axis=0).astype("<u8").view(np.uint8).reshape(len(at), BITS)
    votes[full] += np.add.reduceat(partial, first, axis=0, dtype=np.int64)


def fingerprints(texts: list[str]) -> np.ndarray:
    """len(texts) x 16 bytes."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for w in words(*text_bytes(pa.array(texts, pa.large_string()))):
        doc, h = shingles(w, WORDS)
        if not len(h):
            continue
        count = np.bincount(doc, minlength=w.last - w.first)
        votes = np.zeros((len(count), BITS), np.int64)
        for lo in range(0, len(h), TERMS):  # votes add up, so long texts are counted a part at a time
            _vote(votes, doc[lo : lo + TERMS], h[lo : lo + TERMS])
        full = np.flatnonzero(count)
        out[w.first + full] = np.packbits(2 * votes[full] > count[full][:, None], axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(1, dtype=np.int64) / BITS


def edit(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compared(ids: list, texts: list[str], following: list[str], id_type: pa.DataType, chained: bool = False) -> pa.RecordBatch:
    """Rows of the result; where each text follows the one before, its fingerprint serves both."""
    n = len(ids)
    changed = [edit(t, f) for t, f in zip(texts, following, strict=True)]
    prints = fingerprints([*changed, *texts, *(following[-1:] if chained else following)])
    other, own, after = prints[:n], prints[n : 2 * n], prints[n + 1 : 2 * n + 1] if chained else prints[2 * n :]
    columns = [
        pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array([p.tobytes().hex() for p in own]), pa.array([p.tobytes().hex() for p in other]),
        pa.array(likeness(own, other)), pa.array(likeness(own, after)),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SQL = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row for each document: its fingerprint, that of its edit, and how alike it is to the edit and the next."""
    spark = docs.sparkSession
    small_batches(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    # rows that share a doc_id are dealt on by their texts, equal rows by where they come from
    order = [F.col("doc_id").asc_nulls_first(), "hash", "salt"]
    dealt = (
        docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("salt"))
        .repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, texts, head, kind = [], [], None, None

        def rows(batch: pa.RecordBatch, first: list, last: list) -> pa.RecordBatch:
            n = batch.num_rows
            extra = [pa.array([part] * n, pa.int32()), pa.array(first, pa.string()), pa.array(last, pa.string())]
            return pa.RecordBatch.from_arrays([*batch.columns, *extra], [*_NAMES, "part", "head", "last"])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            ids, texts = ids + batch.column("doc_id").to_pylist(), texts + batch.column("text").to_pylist()
            n = len(ids) - 1
            if n > 0:
                first = [None] * n
                if head is None:
                    head = first[0] = texts[0]
                yield rows(_compared(ids[:n], texts[:n], texts[1:], kind, chained=True), first, [None] * n)
            ids, texts = ids[n:], texts[n:]
        if ids:  # the last row waits for the first of the next range
            empty = pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), *[pa.nulls(1, t) for t in (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2)]], _NAMES
            )
            yield rows(empty, [texts[0] if head is None else None], texts)

    made = keep(dealt.mapInArrow(run, f"doc_id {key}, {_SQL}, part int, head string, last string"), "simhash")
    heads = made.where("head is not null").select("part", "head")
    # one row for each range: their number is that of the partitions, not of documents
    order = Window.orderBy("part")
    following = heads.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next"))
    waiting = (
        made.where("last is not null").select("doc_id", "part", "last").join(following, "part")
        .join(heads.select(F.col("part").alias("next"), "head"), "next").select("doc_id", "last", "head")
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _compared(b.column("doc_id").to_pylist(), b.column("last").to_pylist(), b.column("head").to_pylist(), b.schema.field("doc_id").type)

    return made.where("last is null").select(*_NAMES).unionByName(waiting.mapInArrow(finish, f"doc_id {key}, {_SQL}"))


def table_blocks(radius: int, blocks: int) -> list[tuple[int, ...]]:
    """The blocks that each table's key holds."""
    if not 0 <= radius < blocks or DIGITS % blocks or blocks % 2:
        raise ValueError("blocks must be even, more than radius, and divide the digits of a fingerprint")
    return list(itertools.combinations(range(blocks), blocks - radius))


def neighbours(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, small: int = SMALL_GROUP,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(fingerprint, n_near) of distinct ``prints`` (fingerprint, times): rows of other fingerprints within the radius."""
    tables = table_blocks(radius, blocks)
    width = DIGITS // blocks
    prints = prints.withColumn("id", F.monotonically_increasing_id())
    numbered = keep(prints, "prints")
    bits = len(tables).bit_length()
    # a key holds its table's number; narrow rows, as there is one for each fingerprint and table
    keys = [
        F.shiftleft(F.xxhash64(*[F.substring("fingerprint", b * width + 1, width) for b in t], F.lit(k)), bits).bitwiseOR(F.lit(k).cast("bigint"))
        for k, t in enumerate(tables)
    ]
    entries = numbered.select("id", F.explode(F.array(*keys)).alias("key"))
    members = F.count("*").over(Window.partitionBy("key"))
    met = keep(entries.withColumn("members", members).where("members > 1"), "blocks")
    number = lambda at: F.conv(F.substring("fingerprint", at, 16), 16, -10).cast("bigint")
    known = numbered.select("id", "times", number(1).alias("f1"), number(17).alias("f2"))
    shared = keep(met.join(known, "id").withColumn("table", F.col("key").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")), "blocks")

    # two prints count in the first table whose blocks they share; a mask tells equal blocks, the first block as the lowest bit
    wanted = [sum(1 << b for b in t) for t in tables]
    before = [sum(1 << b for b in range(t[-1]) if b not in t) for t in tables]
    half, size = blocks // 2, BITS // blocks

    few = shared.where(F.col("members") <= small)
    p, q = few.alias("p"), few.alias("q")
    x = [F.col(f"p.{f}").bitwiseXOR(F.col(f"q.{f}")) for f in ("f1", "f2")]
    apart = F.bit_count(x[0]) + F.bit_count(x[1])
    alike = functools.reduce(lambda m, b: m + F.when(
        F.shiftrightunsigned(x[b // half], BITS // 2 - size * (b % half + 1)).bitwiseAND(F.lit((1 << size) - 1)) == 0, 1 << b
    ).otherwise(0), range(blocks), F.lit(0))
    at = F.col("p.table") + 1
    first = (alike.bitwiseAND(F.element_at(F.lit(wanted), at)) == F.element_at(F.lit(wanted), at)) & (alike.bitwiseAND(F.element_at(F.lit(before), at)) == 0)
    pairs = p.join(q, "key").where((F.col("p.id") != F.col("q.id")) & (apart <= radius) & first)
    counts = pairs.groupBy("p.id").agg(F.sum("q.times").alias("n"))

    many = shared.where(F.col("members") > small).withColumn("dealt", F.ceil(F.col("members") / block_rows).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("id"), F.col("dealt")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("dealt") - 1)))
    many = many.select(
        "key", "table", "id", "times", "f1", "f2", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf[["f1", "f2"]].to_numpy().astype(np.int64).view(np.uint64)
        times, own, crossing = pdf["times"].to_numpy(), pdf["own"].to_numpy(), pdf["lo"].iat[0] != pdf["hi"].iat[0]
        table = pdf["table"].iat[0]
        shifts = np.array([BITS // 2 - size * (b % half + 1) for b in range(blocks)], np.uint64)
        sides, mask = np.array([b // half for b in range(blocks)]), np.uint64((1 << size) - 1)
        n = np.zeros(len(f), np.int64)
        for i in range(len(f)):
            x = f ^ f[i]
            near = np.bitwise_count(x).sum(1, dtype=np.int64) <= radius
            near[i] = False
            if crossing:
                near &= own != own[i]
            at = np.flatnonzero(near)
            if len(at):
                same = ((x[at][:, sides] >> shifts) & mask) == 0
                alike = (same * (1 << np.arange(blocks))).sum(1)
                n[i] = times[at[((alike & wanted[table]) == wanted[table]) & ((alike & before[table]) == 0)]].sum()
        return pd.DataFrame({"id": pdf["id"], "n": n})[n > 0]

    blocked = many.groupBy("key", "lo", "hi").applyInPandas(run, "id bigint, n bigint")
    near = counts.unionByName(blocked).groupBy("id").agg(F.sum("n").alias("n_near"))
    return numbered.select("id", "fingerprint").join(near, "id").select("fingerprint", "n_near")


def with_neighbours(compared: DataFrame, **options) -> DataFrame:
    """``edited``'s rows and n_near: how many other documents' fingerprints are within the radius."""
    prints = keep(compared.groupBy("fingerprint").agg(F.count("*").alias("times")), "prints")
    near = prints.join(neighbours(prints, **options), "fingerprint", "left").select(
        "fingerprint", (F.col("times") - 1 + F.coalesce("n_near", F.lit(0))).alias("n_near")
    )
    return compared.join(near, "fingerprint")
