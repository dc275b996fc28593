"""Near-duplicates by BagMinHash signatures of weighted word shingles.

A text is the multiset of its five-word shingles. Each (shingle, weight) has a Poisson process of points over
weight and time. The weights are discretised, exactly for counts, to unit cells, and the cells to the dyadic
intervals [0,1), [1,2), [2,4), [4,8), ...; each interval has one process at a rate in proportion to its width,
and each point descends into the cell where it lies. A point counts if its cell is below the weight, so equal cells of
two texts have equal points, whatever their other weights. Each point draws one of the signature's
components; the component keeps the earliest. Two texts agree in a component with a probability that is
exactly their weighted Jaccard similarity. Points are made in order of time, and only up to a time by which all
components have a point most likely (a text where one has none gets twice the time), so that the work for a text is
about m log m points, however heavy it is.

Signatures are banded; bands with equal keys are *buckets*. Texts with equal multisets are one *node* throughout.
Every member of a bucket is verified against the bucket's least and greatest node by exact multiset overlap, which
is linear in the bucket. Buckets whose members are not in one class yet are compared further, member against member of
another class: small ones by joins, large ones in blocks within tasks, which emit only verified links. So no link between
candidates is lost, and no task holds more than two blocks. Classes are connected components.

Null and empty texts are equal texts without shingles and form one class; a text of fewer than five words is one shingle.
Repeated rows and doc_ids keep their rows. A class id is the least doc_id in it (rows whose doc_id is null are
linked like others; a class of such rows only has the id null). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import keep, small_batches
from gramlode.llm.groups import classes
from gramlode.llm.words import Words, mix, shingles, text_bytes, words

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
SMALL_BUCKET = 64
BLOCK = 1024
BROADCAST_ROWS = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def multiset(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle hash, count), sorted by document and hash."""
    doc, h = shingles(w, WORDS)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def copies(doc: np.ndarray, h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multiset as a set: the k-th copy of a shingle is an element of its own. Sizes and overlaps stay the same."""
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(doc, count), mix(np.repeat(h, count) + _GOLDEN * nth.astype(np.uint64))


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """BagMinHash of every document with a shingle: n_docs x m, uint64; all bits set where there is none."""
    out = np.full((n_docs, m), np.iinfo(np.uint64).max)
    if not len(doc):
        return out
    weight = np.bincount(doc, count, n_docs)
    horizon = np.zeros(n_docs)
    horizon[weight > 0] = (np.log(m) + 4) / weight[weight > 0]
    # intervals of each shingle: 0 is [0,1), j is [2^(j-1), 2^j); used where they begin below its count
    n_intervals = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 2))).astype(int) + 1, 1)
    element = np.repeat(np.arange(len(doc)), n_intervals)
    j = np.arange(len(element)) - np.repeat(np.cumsum(n_intervals) - n_intervals, n_intervals)
    low = np.where(j > 0, 2 ** np.maximum(j - 1, 0), 0).astype(np.int64)
    width = np.maximum(low, 1)
    key, below, owner = mix(h[element] ^ (_GOLDEN * (j + 1).astype(np.uint64))), count[element], doc[element]
    todo = np.arange(len(element))
    while len(todo):
        time, nth, block, live = np.zeros(len(todo)), 0, 3, todo
        while len(live):
            steps = (np.arange(nth, nth + block).astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            draw = mix(key[live][:, None] + steps[None, :])
            gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            at = time[:, None] + np.cumsum(gap, 1) / (m * width[live])[:, None]
            end = horizon[owner[live]][:, None]
            r, c = np.nonzero(at <= end)
            e = live[r]
            second = mix(draw[r, c] + _GOLDEN)
            cell = low[e] + (((second >> np.uint64(40)) * width[e].astype(np.uint64)) >> np.uint64(24)).astype(np.int64)
            use = cell < below[e]
            r, c, e, second = r[use], c[use], e[use], second[use]
            slot = owner[e] * m + (second & np.uint64(0xFFFFFF)).astype(np.int64) % m
            when = (at[r, c] / end[r, 0] * (2**32 - 1)).astype(np.uint64)
            np.minimum.at(out.reshape(-1), slot, (when << np.uint64(32)) | (mix(second) >> np.uint64(32)))
            more = at[:, -1] <= end[:, 0]
            live, time = live[more], at[more, -1]
            nth, block = nth + block, min(64, block * 2)
        lacking = (out == np.iinfo(np.uint64).max).any(1) & (weight > 0)
        horizon[lacking] *= 2
        out[lacking] = np.iinfo(np.uint64).max
        todo = np.flatnonzero(lacking[owner])
    # which point won, not when it came: times are scaled by text
    empty = weight == 0
    out &= np.uint64(0xFFFFFFFF)
    out[empty] = np.iinfo(np.uint64).max
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + signature[:, r * bands : (r + 1) * bands] + np.uint64(r + 1))
    return keys


def _fingerprint(doc: np.ndarray, element: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that are equal for equal multisets."""
    first, second = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
    np.add.at(first, doc, element)
    np.add.at(second, doc, mix(element ^ _GOLDEN))
    return first, second


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, c1, c2, n, bands): c1 and c2 tell the multiset, n is its size."""
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            parts = []
            for w in words(data, offsets):
                n = w.last - w.first
                counted = multiset(w)
                doc, element = copies(*counted)
                c1, c2 = _fingerprint(doc, element, n)
                keys = band_keys(signatures(*counted, n, bands * rows), bands, rows)
                parts.append((c1, c2, np.bincount(doc, minlength=n), keys))
            c1, c2, n, keys = (np.concatenate(p) for p in zip(*parts, strict=True))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)),
                 pa.array(n.astype(np.int64)), lists],
                ["doc_id", "text_hash", "c1", "c2", "n", "bands"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {key}, text_hash bigint, c1 bigint, c2 bigint, n bigint, bands array<bigint>")


def _elements(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, elements): the multisets of ``nodes`` (node, doc_id, text_hash), from the texts."""
    few = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = F.broadcast(nodes) if few else nodes
    source = (
        docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text").alias("d")
        .join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash")))
        .select("node", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            values, sizes = [], []
            for w in words(data, offsets):
                doc, element = copies(*multiset(w))
                values.append(element.view(np.int64))
                sizes.append(np.bincount(doc, minlength=w.last - w.first))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "elements"])

    # a doc_id and text may be repeated: one row of each node is enough
    return source.mapInArrow(run, "node bigint, elements array<bigint>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose multisets overlap enough."""
    sides = (
        pairs.join(elements.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a")
        .join(elements.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    )
    shared = F.size(F.array_intersect("ea", "eb"))
    return sides.where(shared >= similarity * (F.size("ea") + F.size("eb") - shared) - 1e-9).select("a", "b")


def _block_links(members: DataFrame, elements: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links between members (band, key, node, label, bands) of different labels in large buckets."""
    counts = members.groupBy("band", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = (
        members.join(counts, ["band", "key"])
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "key", "node", "label", "bands", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        .join(elements, "node")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node, label = pdf["node"].to_numpy(), pdf["label"].to_numpy()
        own, lo, hi, band = pdf["own"].to_numpy(), pdf["lo"].iat[0], pdf["hi"].iat[0], pdf["band"].iat[0]
        keys = np.stack(pdf["bands"].to_numpy())
        sizes = np.array([len(e) for e in pdf["elements"]])
        flat = np.concatenate(pdf["elements"].to_numpy())
        owner = np.repeat(np.arange(len(node)), sizes)
        _, slot = np.unique(flat, return_inverse=True)
        order = np.argsort(slot, kind="stable")
        begin = np.searchsorted(slot[order], np.arange(slot.max(initial=-1) + 2))
        posting, ends = owner[order], np.cumsum(sizes)
        a, b = [], []
        for i in range(len(node)):
            mine = slot[ends[i] - sizes[i] : ends[i]]
            length = begin[mine + 1] - begin[mine]
            at = np.repeat(begin[mine], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            shared = np.bincount(posting[at], minlength=len(node))
            near = (shared >= similarity * (sizes[i] + sizes - shared) - 1e-9) & (label != label[i]) & (np.arange(len(node)) > i)
            if lo != hi:
                near &= own != own[i]
            # only in the first band where the two meet
            for k in np.flatnonzero(near):
                if np.argmax(keys[i] == keys[k]) == band:
                    a.append(node[i])
                    b.append(node[k])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return dealt.groupBy("band", "key", "lo", "hi").applyInPandas(run, "a bigint, b bigint")


def _relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after links (a, b) between nodes: labels that are linked become the least of them.

    Both are tables that ``keep`` returned, as is the result.
    """
    if links.isEmpty():
        return label
    ends = links.join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b")
    merged = classes(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    merged = merged.select(F.col("node").alias("label"), F.col("class_id").alias("new"))
    return keep(label.join(merged, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                 small_bucket: int = SMALL_BUCKET, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, node, class_id): a row for each row of ``docs``; near-duplicates share class_id.

    node tells equal multisets; class_id is the least doc_id of a class.
    """
    signed = keep(sign(docs, bands, rows), "signed")
    # a node is its least doc_id; multisets that only rows without doc_id have, or ids that repeat, go by a hash
    least = F.min(F.struct("doc_id", "text_hash"))
    reps = signed.groupBy("c1", "c2").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("named"),
        least.alias("any"), F.first("n").alias("n"), F.first("bands").alias("bands"),
    ).select(
        "c1", "c2", "n", "bands", F.xxhash64("c1", "c2").alias("node"),
        F.coalesce("named", "any").getField("doc_id").alias("doc_id"), F.coalesce("named", "any").getField("text_hash").alias("text_hash"),
    )
    reps = keep(reps, "nodes")
    buckets = reps.where("n > 0").select("node", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("members"), F.min("node").alias("least"), F.max("node").alias("most"))
    members = keep(buckets.join(shared.where("members > 1"), ["band", "key"]), "buckets")
    hubs = members.select(F.col("node").alias("a"), F.explode(F.array("least", "most")).alias("b")).where("a <> b")
    hubs = keep(hubs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    involved = members.select("node").distinct()
    wanted = keep(reps.join(involved, "node").select("node", "doc_id", "text_hash"), "wanted")
    elements = keep(_elements(docs, wanted), "elements")
    links = keep(_verified(hubs, elements, similarity), "links")
    label = _relabelled(keep(involved.withColumn("label", F.col("node")), "labels"), links)

    def open_buckets(low: int, high: int) -> DataFrame:
        """Members of the buckets of some bands that hold more than one class."""
        labelled = members.where(F.col("band").between(low, high)).join(label, "node")
        mixed = labelled.groupBy("band", "key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        return labelled.join(mixed.select("band", "key"), ["band", "key"]).select("band", "key", "node", "label", "members")

    unsettled = keep(open_buckets(0, bands - 1), "open")
    small = unsettled.where(F.col("members") <= small_bucket)
    one, two = small.alias("p"), small.alias("q")
    pairs = one.join(two, ["band", "key"]).where("p.node < q.node and p.label <> q.label")
    pairs = pairs.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct().join(hubs, ["a", "b"], "left_anti")
    links = keep(_verified(pairs, elements, similarity), "links")
    label = _relabelled(label, links)
    # links of one band settle most buckets of the next ones: a few bands first, then the others at once
    steps = [0, 1, 5, bands] if unsettled.where(F.col("members") > small_bucket).limit(1).count() else [0]
    for low, high in zip(steps, steps[1:], strict=False):
        large = keep(open_buckets(low, high - 1).where(F.col("members") > small_bucket), "open")
        links = keep(_block_links(large.join(reps.select("node", "bands"), "node"), elements, similarity, block), "links")
        label = _relabelled(label, links)
    named = reps.join(label, "node", "left").withColumn("class_node", F.coalesce("label", "node"))
    least_id = named.groupBy("class_node").agg(F.min("doc_id").alias("class_id"))
    ids = named.select("c1", "c2", "class_node").join(least_id, "class_node")
    return signed.select("doc_id", "text_hash", "c1", "c2").join(ids, ["c1", "c2"]).select(
        "doc_id", "text_hash", F.col("class_node").alias("node"), "class_id"
    )


def with_sizes(classed: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, kept): kept is true for the row whose doc_id names the class."""
    sizes = classed.groupBy("node").agg(F.count("*").alias("class_size"))
    return classed.join(sizes, "node").select(
        "doc_id", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept")
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, one of each class: that of the least doc_id, of equal doc_ids the least by hash of text.

    Of rows that repeat a doc_id and text, the first by their other columns stays.
    """
    classed = keep(near_classes(docs, **options), "classes")
    best = classed.groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("w")
    ).select("node", "w.doc_id", "w.text_hash")
    tally = classed.groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    same = tally["node"].eqNullSafe(best["node"]) & tally["doc_id"].eqNullSafe(best["doc_id"]) & tally["text_hash"].eqNullSafe(best["text_hash"])
    winners = tally.join(best, same, "left_semi")
    losers = keep(tally.join(best, same, "left_anti").select("doc_id", "text_hash"), "losers")
    repeated = keep(winners.where("times > 1").select("doc_id", "text_hash"), "repeated")
    # rows travel as one struct, so that no name of theirs meets ours
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.struct(*columns).alias("row"))

    def among(rows: DataFrame, how: str) -> DataFrame:
        few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        rows = rows.toDF("of_id", "of_hash")
        side = F.broadcast(rows) if few else rows
        return hashed.join(side, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")), how)

    hashed = among(losers, "left_anti")
    single = among(repeated, "left_anti")
    several = among(repeated, "left_semi").dropDuplicates(["id", "hash"])
    return single.unionByName(several).select("row.*")
