"""Byte-level BPE by monoid tree reduction.

A text is halved until the leaves are small. Leaves are encoded alone, and neighbours are joined up the
tree. A join re-encodes only a window around the seam. The window grows, doubling, until either end lies on
a *sync point*: a space or newline after a non-space character. No match of the pattern holds such a pair,
and how the pattern matches from a position on depends on nothing before it, so the tokens outside the
window are those of the whole text. Where there is no sync point the window grows to the end of the segment.
Decoding concatenates the bytes of the halves.

Texts over ``part_chars`` are cut into parts that separate tasks encode; one task joins the parts of a text.
Null texts count as empty. An empty text has no tokens. Rows are independent of each other: repeated rows
and repeated or null doc_ids give a row each. Other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from gramlode.llm.common import rank_encoding, small_batches, vocabulary

RANKS = "byte_bpe_multi_50k.tiktoken"
LEAF_CHARS = 512
PART_CHARS = 1 << 20
FIRST_WINDOW = 64
_SYNC = re.compile(r"(?<=\S)[ \n]")
_NONE = np.empty(0, np.uint32)


def leaf_ids(encoding, text: str) -> np.ndarray:
    return encoding.encode_to_numpy(text, disallowed_special=()) if text else _NONE


def left_sync(text: str, lo: int, seam: int) -> int:
    """The last sync point of text[lo:seam], else lo."""
    width = FIRST_WINDOW
    while True:
        start = max(lo, seam - width)
        at = [m.start() for m in _SYNC.finditer(text, start, seam) if m.start() > lo]
        if at:
            return at[-1]
        if start == lo:
            return lo
        width *= 2


def right_sync(text: str, seam: int, hi: int) -> int:
    """The first sync point of text[seam:hi], else hi."""
    width = FIRST_WINDOW
    while True:
        end = min(hi, seam + width)
        # the character before the sync point belongs to the right segment too
        m = _SYNC.search(text, seam + 1, end)
        if m:
            return m.start()
        if end == hi:
            return hi
        width *= 2


def join_ids(encoding, text: str, lo: int, seam: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of text[lo:hi] from those of text[lo:seam] and text[seam:hi]."""
    if lo == seam or seam == hi:
        return right if lo == seam else left
    i, j = left_sync(text, lo, seam), right_sync(text, seam, hi)
    gone_left = len(leaf_ids(encoding, text[i:seam]))
    gone_right = len(leaf_ids(encoding, text[seam:j]))
    window = leaf_ids(encoding, text[i:j])
    return np.concatenate([left[: len(left) - gone_left], window, right[gone_right:]])


def encode_tree(encoding, text: str, lo: int = 0, hi: int | None = None, leaf: int = LEAF_CHARS) -> np.ndarray:
    """Ids of text[lo:hi], by halves."""
    hi = len(text) if hi is None else hi
    if hi - lo <= leaf:
        return leaf_ids(encoding, text[lo:hi])
    seam = (lo + hi) // 2
    halves = encode_tree(encoding, text, lo, seam, leaf), encode_tree(encoding, text, seam, hi, leaf)
    return join_ids(encoding, text, lo, seam, hi, *halves)


def join_tree(encoding, text: str, cuts: list[int], parts: list[np.ndarray]) -> np.ndarray:
    """Ids of the whole text from those of the parts between neighbouring cuts."""
    while len(parts) > 1:
        joined, ends = [], [cuts[0]]
        for k in range(0, len(parts), 2):
            if k + 1 < len(parts):
                joined.append(join_ids(encoding, text, *cuts[k : k + 3], parts[k], parts[k + 1]))
                ends.append(cuts[k + 2])
            else:
                joined.append(parts[k])
                ends.append(cuts[k + 1])
        parts, cuts = joined, ends
    return parts[0] if parts else _NONE


def decode_tree(encoding, ids: np.ndarray, leaf: int = LEAF_CHARS) -> bytes:
    """The bytes of the ids, by halves."""
    if len(ids) <= leaf:
        return encoding.decode_bytes(ids.tolist())
    seam = len(ids) // 2
    return decode_tree(encoding, ids[:seam], leaf) + decode_tree(encoding, ids[seam:], leaf)


def id_bytes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def encode(docs: DataFrame, ranks: str | None = None, leaf_chars: int = LEAF_CHARS,
           part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, ids binary): the ids of every whole text as little-endian unsigned 32-bit integers."""
    path = ranks or vocabulary(RANKS)
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    long = F.length("text") > part_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(path)
        for batch in batches:
            ids = [id_bytes(encode_tree(encoding, t, leaf=leaf_chars)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(path)
        for batch in batches:
            ids = [id_bytes(encode_tree(encoding, t, leaf=leaf_chars)) for t in batch.column("piece").to_pylist()]
            yield batch.append_column("ids", pa.array(ids, pa.binary()))

    def joined(pdf):
        encoding = rank_encoding(path)
        pdf = pdf.sort_values("part")
        texts = pdf["piece"].tolist()
        cuts = [0, *np.cumsum([len(t) for t in texts]).tolist()]
        ids = join_tree(encoding, "".join(texts), cuts, [np.frombuffer(b, "<u4") for b in pdf["ids"]])
        return pdf[["row", "doc_id"]].head(1).assign(ids=[id_bytes(ids)])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    short = source.where(~long).mapInArrow(whole, f"doc_id {id_type}, ids binary")
    cut = (
        source.where(long)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / part_chars).cast("int"))))
        .select("row", "doc_id", "part", F.substr("text", F.col("part") * part_chars + 1, F.lit(part_chars)).alias("piece"))
        .repartition("row", "part")
        .mapInArrow(pieces, f"row bigint, doc_id {id_type}, part int, piece string, ids binary")
        .groupBy("row")
        .applyInPandas(joined, f"row bigint, doc_id {id_type}, ids binary")
        .drop("row")
    )
    return short.unionByName(cut)


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids, bytes binary) of ``encode``'s rows."""
    path = ranks or vocabulary(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(path)
        for batch in batches:
            out = [decode_tree(encoding, np.frombuffer(b, "<u4")) for b in batch.column("ids").to_pylist()]
            yield batch.append_column("bytes", pa.array(out, pa.binary()))

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("bytes", BinaryType())]))


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``."""
    return decode(encode(docs, **options)).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
