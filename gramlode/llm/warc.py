"""WARC archives of pages, and reading them back by boundary-chain verification.

``write`` makes a record for each page: a response with an HTTP header and the page's bytes, or, where another page has the
same bytes, a revisit that refers to that response. Spark's text writer does it, with the two line breaks that end a record as its
line separator.

``read`` cuts the archives at every occurrence of the magic line, also at those inside payloads, by Spark's text reader,
so archives are read in splits. Each piece is a *candidate* record: if it has a header, its length names the
offset of its successor. Within a split a task follows the candidates to where they leave the split; between splits, pointer
jumping from the file's start doubles the steps each round. Only candidates that are reached are records;
the rest is payload. The chain of each file must end exactly at the file's end, and each response must have
the digest that its header names, else ``read`` fails. Payloads are checked where they are scanned; only those that hold the magic
line themselves are put together from their pieces.

Null html is an empty payload. Of pages with equal payloads of at least ``least_bytes`` bytes, the largest page_id's is
the response (of repeated rows each); null page_ids are revisits where another id is known, else responses. Line breaks in a URL are
percent-encoded; a null URL has no header line. An empty table makes no records. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlode.llm.common import keep, small_batches
from gramlode.session import fresh_folder

MAGIC = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
BROADCAST_ROWS = 1 << 20
# The digits of base 32, as conv() writes them and as WARC digests do.
_CONV_DIGITS, _BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four of base 32."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _CONV_DIGITS, _BASE32_DIGITS)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(value): each page's record, without the line breaks that end it."""
    body = F.coalesce(F.col("html"), F.lit(""))
    full = pages.select("page_id", "url", body.alias("html"), F.octet_length(body).alias("bytes"), base32_sha1(body.cast("binary")).alias("digest"))
    shared = (
        full.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1 and keeper is not null").select("digest", "keeper")
    )
    shared = keep(shared, "warc-shared")
    side = F.broadcast(shared) if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else shared
    full = full.join(side, "digest", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    lines = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit("\r\n"))
    name = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.col("digest"), F.lit(">"))
    url = F.replace(F.replace(F.col("url").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n")
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    header = F.concat(
        F.lit(MAGIC),
        lines("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        lines("WARC-Record-ID: ", name(F.col("page_id"))),
        lines(f"WARC-Date: {DATE}"),
        F.coalesce(lines("WARC-Target-URI: ", url), F.lit("")),
        lines("WARC-Payload-Digest: sha1:", F.col("digest")),
        F.when(revisit, F.concat(
            lines("WARC-Refers-To: ", name(F.col("keeper"))),
            lines("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        )).otherwise(""),
        lines("Content-Type: application/http; msgtype=response"),
        lines("Content-Length: ", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return full.select(F.concat(header, block).alias("value"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> str:
    """Write the archives of ``pages`` to a new folder."""
    records(pages, least_bytes).write.option("lineSep", RECORD_END).text(folder)
    return folder


def _pieces(spark, folder: str) -> DataFrame:
    """What stands between occurrences of the magic line, in order within a split."""
    text = spark.read.option("lineSep", MAGIC).text(folder)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _header(piece: bytes) -> tuple[int, dict[str, str]] | None:
    """Length of a record's header, with the empty line, and its fields."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    return (end + 4, fields) if length.isascii() and length.isdigit() and len(length) < 19 else None


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header of a block."""
    return block[block.find(b"\r\n\r\n") + 4 :]


def base32_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_CANDIDATE = (
    "file string, block bigint, rel bigint, size bigint, length bigint, content bigint, kind string, name string, refers string, "
    "digest string, bytes bigint, found string"
)


def _candidates(pieces: DataFrame) -> DataFrame:
    """Header fields of each piece that has a header, and size and digest of its payload where the piece holds all of it."""
    extra = len(MAGIC)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rel = None, 0
        names = [c.split()[0] for c in _CANDIDATE.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 5, *[pa.string()] * 4, pa.int64(), pa.string()]
        for batch in batches:
            rows = []
            for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                if (file, block) != place:
                    place, rel = (file, block), 0
                header = _header(value)
                row = [file, block, rel, len(value) + extra, None, None, None, None, None, None, None, None]
                if header:
                    length, fields = header
                    content = int(fields["content-length"])
                    row[4:10] = [length, content, *(fields.get(f) for f in ("warc-type", "warc-record-id", "warc-refers-to", "warc-payload-digest"))]
                    if len(value) >= length + content:
                        payload = payload_of(value[length : length + content])
                        row[10:] = [len(payload), base32_of(payload)]
                rows.append(row)
                rel += len(value) + extra
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return pieces.mapInArrow(run, _CANDIDATE)


def _inside(pos: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Index of each successor among the sorted ``pos``, or -1."""
    at = np.minimum(np.searchsorted(pos, following), len(pos) - 1)
    return np.where((following >= 0) & (pos[at] == following), at, -1)


def _exits(table: pa.Table) -> pa.Table:
    """Where each candidate's chain leaves its split."""
    table = table.sort_by("pos")
    pos, following = table.column("pos").to_numpy(), table.column("next").to_numpy()
    jump, leave = _inside(pos, following), following.copy()
    while (jump >= 0).any():
        go = np.flatnonzero(jump >= 0)
        leave[go], jump[go] = leave[jump[go]], jump[jump[go]]
    return pa.table({"file": table.column("file"), "pos": table.column("pos"), "leave": pa.array(leave)})


def _reached(table: pa.Table) -> pa.Table:
    """The candidates of a split that its entry's chain passes."""
    table = table.sort_by("pos")
    pos = table.column("pos").to_numpy()
    jump = _inside(pos, table.column("next").to_numpy())
    on = table.column("entry").to_numpy(zero_copy_only=False).copy()
    for start in np.flatnonzero(on):
        at = jump[start]
        while at >= 0 and not on[at]:
            on[at] = True
            at = jump[at]
    return table.drop_columns(["entry"]).append_column("on", pa.array(on))


def reachable(candidates: DataFrame) -> DataFrame:
    """The candidates with their file offset ``pos`` (after the magic line) and ``on``: whether the chain from the file's start reaches them."""
    splits = candidates.groupBy("file", "block").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    placed = candidates.join(bases.drop("total"), ["file", "block"]).withColumn("pos", F.col("base") + F.col("rel"))
    after = F.col("pos") + F.col("length") + F.col("content") + len(RECORD_END) + len(MAGIC)
    placed = keep(placed.withColumn("next", F.coalesce(after, F.lit(-1))).drop("base"), "warc-candidates")
    narrow = placed.select("file", "block", "pos", "next")
    step = keep(narrow.groupBy("file", "block").applyInArrow(_exits, "file string, pos bigint, leave bigint"), "warc-exits")
    entries = keep(placed.select("file").distinct().withColumn("pos", F.lit(len(MAGIC)).cast("bigint")), "warc-entries")
    jump, known = step, entries.count()
    while True:
        more = entries.join(jump, ["file", "pos"]).select("file", F.col("leave").alias("pos"))
        entries = keep(entries.unionByName(more.join(step.select("file", "pos"), ["file", "pos"], "left_semi")).distinct(), "warc-entries")
        if (now := entries.count()) == known:
            break
        known = now
        jump = keep(jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.leave") == F.col("b.pos"))).select("a.file", "a.pos", "b.leave"), "warc-jumps")
    ends = entries.join(step, ["file", "pos"], "left").groupBy("file").agg(F.max("leave").alias("end"))
    sizes = splits.groupBy("file").agg(F.sum("total").alias("size"))
    broken = sizes.join(ends, "file", "left").where("end is null or end <> size").select("file").first()
    if broken:
        raise ValueError(f"the records of {broken[0]} do not lead from its start to its end")
    marked = placed.join(entries.withColumn("entry", F.lit(True)), ["file", "pos"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    types = ", ".join(f"{n} {t}" for n, t in marked.dtypes if n != "entry")
    return marked.groupBy("file", "block").applyInArrow(_reached, f"{types}, on boolean")


def _in_pieces(spark, folder: str, chain: DataFrame) -> DataFrame:
    """(file, owner, bytes, found) of the records whose payload holds the magic line."""
    extra = len(MAGIC)
    files = chain.where("on and bytes is null").select("file").distinct()
    own = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    owned = chain.join(files, "file", "left_semi").withColumn("owner", F.last(F.when(F.col("on"), F.col("pos")), ignorenulls=True).over(own))
    heads = chain.where("on and bytes is null").select("file", F.col("pos").alias("owner"), F.col("length").alias("start"), "content")
    wanted = keep(owned.select("file", "block", "rel", "pos", "owner").join(heads, ["file", "owner"]), "warc-pieces")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at = None, 0
        for batch in batches:
            rel = []
            for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                if (file, block) != place:
                    place, at = (file, block), 0
                rel.append(at)
                at += len(value) + extra
            yield batch.append_column("rel", pa.array(rel, pa.int64()))

    side = F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted
    texts = _pieces(spark, folder).mapInArrow(placed, "file string, block bigint, value binary, rel bigint").join(side, ["file", "block", "rel"])

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        whole = MAGIC.encode().join(table.column("value").to_pylist())
        start, content = table.column("start")[0].as_py(), table.column("content")[0].as_py()
        payload = payload_of(whole[start : start + content])
        return pa.table({
            "file": table.column("file")[:1], "pos": table.column("owner")[:1],
            "whole_bytes": pa.array([len(payload)], pa.int64()), "whole_found": pa.array([base32_of(payload)]),
        })

    return texts.groupBy("file", "owner").applyInArrow(together, "file string, pos bigint, whole_bytes bigint, whole_found string")


def read(spark, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of the archives."""
    small_batches(spark)
    chain = keep(reachable(keep(_candidates(_pieces(spark, folder)), "warc-found")), "warc-chain")
    found = chain.where("on")
    if chain.where("on and bytes is null").limit(1).count():
        found = found.join(_in_pieces(spark, folder, chain), ["file", "pos"], "left")
        found = found.withColumn("bytes", F.coalesce("bytes", "whole_bytes")).withColumn("found", F.coalesce("found", "whole_found"))
    digest = F.regexp_replace("digest", "^sha1:", "")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]*):", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("bigint")
    found = found.select("kind", "name", "refers", digest.alias("digest"), "bytes", "found")
    same = F.col("found") == F.col("digest")
    checked = F.when(same, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("name"))))
    responses = found.where("kind = 'response'").withColumn("digest", checked)
    sizes = responses.groupBy("name").agg(F.first("bytes").alias("whole"))
    revisits = found.where("kind = 'revisit'").join(sizes.withColumnRenamed("name", "refers"), "refers", "left")
    return responses.select(
        number("name").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
        F.lit(None).cast("bigint").alias("refers_to"),
    ).unionByName(revisits.select(
        number("name").alias("page_id"), F.col("whole").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
        number("refers").alias("refers_to"),
    ))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read those."""
    spark = pages.sparkSession
    return read(spark, write(pages, fresh_folder(spark, "warc"), least_bytes))
