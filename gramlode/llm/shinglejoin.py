"""Exact Jaccard join on word shingles by token-combination prefixes.

A document is the set of its distinct five-word shingles, its *tokens*; two link when ``100 * shared >= percent * union``.
Tokens have one order, by document frequency and hash, and a class by frequency: rare ones (class 1), frequent ones
(2), very frequent ones (3). Let a set of n tokens miss at most t = n - ceil(percent n / 100) tokens of a partner. Its prefix
is extended in that order until, summed over classes, the tokens beyond the first k - 1 of a class k come to t + 1. Take
the partner whose prefix ends first: what t misses leave of it lies in the other prefix too, and holds k tokens of some
class k. So partners share a single rare token or a k-token combination of a class, and those are the *signatures* that
are indexed: singles for rare tokens, combinations for frequent ones. Lest combinations grow with the square of a
prefix, frequent classes are cut by a hash into as many parts as sets of that size need. Sizes lie in octaves; a set whose
partners may lie in the next octave gives the signatures of both. With 80 percent or more no set lacks a prefix: sets of up to
three tokens link to equal sets only.

Two facts spare most of the work. Equal sets are one *node*; and a token that occurs in no other node (its frequency is
the number of copies) can be nobody's shared token, so a set with more than t of those links to nothing and gives no signature.

How it runs: tasks cut the texts they scan into batches; each asks for the frequencies of its distinct tokens, shuffled by
ranges of the hash, and gets them back. Nodes that share a signature form a group. Every member is verified against the least
and the greatest node of its group; of groups that are not one class then, all members of different classes are verified,
in pairs where a group is small, in blocks where it is large, and classes are joined after each step. All verification is
exact, no candidate is left out, and no task holds more than two blocks of sets. Classes are connected components.

Null texts are empty; texts without words are empty sets, linked with nothing, not even with each other. Fewer than five
words are one shingle. Every row gives a row: repeated rows and doc_ids stay. A component's id is its least doc_id (rows
without a doc_id are linked like others; a component of such rows only has the id null). An empty table gives no rows. Other columns
are not read. Shingles are told apart by 64-bit hashes, equal sets by 128 bits.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import discard, keep, keep_bucketed, small_batches
from gramlode.llm.groups import classes
from gramlode.llm.lm import from_sorted_bytes, shard_bounds, sorted_bytes, squeeze, unsqueeze
from gramlode.llm.words import mix, shingles, text_bytes, words

WORDS = 5
PERCENT = 80
CLASSES = (64, 4096)  # frequencies up to which a token is of class 1, of class 2
PART = 20  # tokens of a set for each part of a frequent class
BATCH_BYTES = 2 << 20
SHARD_TOKENS = 1 << 20
SMALL = 64
BLOCK = 512
BLOCK_TOKENS = 1 << 18
NODE_BYTES = 1 << 21
SPARE_BITS = 10
SIZE_STEP = 1.12  # two steps are more than the greatest ratio of sizes that link, 1.25
LANE = 4096
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each run of values; runs end at ``ends``."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return np.diff(total[ends], prepend=values.dtype.type(0))


def sets_of(docs: DataFrame, size: int = WORDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row for each batch of texts: doc ids, set sizes, two sums that tell the set, distinct tokens, tokens as indices.

    ``batch`` numbers its first document; the others follow.
    """
    small_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids, owners, hashes, held, kind = [], [], [], 0, pa.int64()

        def made() -> pa.RecordBatch:
            nonlocal number, held
            vocabulary, at = np.unique(np.concatenate(hashes), return_inverse=True)
            members = np.unique((np.concatenate(owners) << 32) | at)
            doc, at = members >> 32, members & 0xFFFFFFFF
            sizes = np.bincount(doc, minlength=len(ids))
            tokens, ends = vocabulary[at], np.cumsum(sizes)
            c1, c2 = _sums(mix(tokens), ends), _sums(mix(tokens ^ _GOLDEN), ends)
            columns = [
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([squeeze(sizes.astype(np.int32))]),
                pa.array([c1.tobytes()]), pa.array([c2.tobytes()]), pa.array([sorted_bytes(vocabulary)]),
                pa.array([squeeze(np.diff(at.astype(np.int32), prepend=np.int32(0)))]), pa.array([len(at)], pa.int64()),
            ]
            number += len(ids)
            held = 0
            for x in (ids, owners, hashes):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["batch", "docs", "sizes", "c1", "c2", "words", "tokens", "n_tokens"])

        for batch in arrow:
            kind = batch.schema.field("doc_id").type
            data, offsets = text_bytes(batch.column("text"))
            all_ids = batch.column("doc_id").to_pylist()
            for w in words(data, offsets):
                doc, h = shingles(w, size)
                owners.append(doc.astype(np.int64) + len(ids))
                hashes.append(h)
                ids.extend(all_ids[w.first : w.last])
                held += int(offsets[w.last] - offsets[w.first]) + w.last - w.first
                if held >= batch_bytes:
                    yield made()
        if ids:
            yield made()

    schema = f"batch bigint, docs array<{key}>, sizes binary, c1 binary, c2 binary, words binary, tokens binary, n_tokens bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _opened(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _cells(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def members(batches: DataFrame) -> DataFrame:
    """(row, batch, doc_id, n, c1, c2) of every document."""
    key = batches.schema["docs"].dataType.elementType.simpleString()

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in arrow:
            kind = record.schema.field("docs").type.value_type
            for b in _opened(record):
                n = unsqueeze(b["sizes"], np.int32).astype(np.int64)
                number = b["batch"] + np.arange(len(n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number), pa.array(np.full(len(n), b["batch"])), pa.array(b["docs"], kind), pa.array(n),
                     pa.array(np.frombuffer(b["c1"], np.int64)), pa.array(np.frombuffer(b["c2"], np.int64))],
                    ["row", "batch", "doc_id", "n", "c1", "c2"],
                )

    schema = f"row bigint, batch bigint, doc_id {key}, n bigint, c1 bigint, c2 bigint"
    return batches.select("batch", "docs", "sizes", "c1", "c2").mapInArrow(run, schema)


def frequencies(batches: DataFrame, shards: int, total: int) -> DataFrame:
    """(batch, shard, counts): in how many documents each distinct token of a batch occurs, in the batch's order.

    Tokens are told apart here by so many upper bits that one in a thousand shares them with another of the ``total``. Both then count
    as more frequent, which any order allows.
    """
    drop = np.uint64(max(0, 64 - SPARE_BITS - max(total, 1).bit_length()))

    def ask(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in arrow:
            for b in _opened(record):
                vocabulary = from_sorted_bytes(b["words"])
                at = np.cumsum(unsqueeze(b["tokens"], np.int32), dtype=np.int32)
                n = np.bincount(at, minlength=len(vocabulary)).astype(np.int32)
                bounds, out = shard_bounds(vocabulary, shards), []
                for s in np.flatnonzero(np.diff(bounds)):
                    part = slice(bounds[s], bounds[s + 1])
                    out.append((int(s), b["batch"], sorted_bytes(vocabulary[part] >> drop), squeeze(n[part])))
                yield _cells(out, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["shard", "batch", "grams", "n"])

    def answer(table: pa.Table) -> pa.Table:
        asked = [from_sorted_bytes(g.as_py()) for g in table.column("grams")]
        given = [unsqueeze(n.as_py(), np.int32) for n in table.column("n")]
        ends = np.cumsum([len(a) for a in asked])
        grams, at = np.unique(np.concatenate(asked), return_inverse=True)
        n = np.minimum(np.bincount(at, np.concatenate(given), len(grams)), 2**31 - 1).astype(np.int32)
        parts = [squeeze(n[at[lo:hi]]) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.table({"batch": table.column("batch"), "shard": table.column("shard"), "counts": pa.array(parts, pa.binary())})

    asked = batches.select("batch", "words", "tokens").mapInArrow(ask, "shard int, batch bigint, grams binary, n binary")
    return asked.groupBy("shard").applyInArrow(answer, "batch bigint, shard int, counts binary")


@functools.lru_cache(maxsize=256)
def _combinations(n: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), k)), np.int64).reshape(-1, k)


def signatures(tokens: np.ndarray, frequency: np.ndarray, single: int, percent: int = PERCENT, limits: tuple[int, int] = CLASSES) -> np.ndarray:
    """Signatures of a set: its tokens that others may have too, with frequencies, and the number of tokens of its own besides."""
    n = len(tokens) + single
    need = n - -(-n * percent // 100) + 1 - single
    if need <= 0 or n <= 3:
        return np.empty(0, np.uint64)
    order = np.lexsort((tokens, frequency))
    tokens, frequency = tokens[order], frequency[order]
    rare = int(np.searchsorted(frequency, limits[0], "right"))
    out = [mix(tokens[: min(rare, need)] + np.uint64(1))]
    octave = n.bit_length() - 1
    for scheme in (octave, octave + 1) if n * 100 >= percent << (octave + 1) else (octave,):
        if rare >= need:
            break
        parts = max(1, (1 << scheme) // PART)
        h, k = tokens[rare:], np.where(frequency[rare:] <= limits[1], 2, 3)
        salt = mix(np.array([scheme + 7], np.uint64))
        part = (mix(h ^ salt) % np.uint64(parts)).astype(np.int64) * 2 + k - 2
        by_part = np.argsort(part, kind="stable")
        start = np.searchsorted(part[by_part], part[by_part])
        nth = np.empty(len(h), np.int64)
        nth[by_part] = np.arange(len(h)) - start
        counts = np.cumsum(nth >= k - 1)
        end = int(np.searchsorted(counts, need - rare)) + 1
        chosen = by_part[by_part < end]
        edges = np.flatnonzero(np.diff(part[chosen], prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            size = int(k[chosen[lo]])
            if hi - lo >= size:
                combined = mix(h[chosen[lo:hi]])[_combinations(int(hi - lo), size)].sum(1, dtype=np.uint64)
                out.append(mix(combined + salt * np.uint64(size)))
    return np.unique(np.concatenate(out))


def nodes_of(batches: DataFrame, answers: DataFrame, kept: DataFrame, percent: int = PERCENT, limits: tuple[int, int] = CLASSES) -> DataFrame:
    """(node, n, single, tokens, sigs) of the sets that may link; ``kept`` has (batch, chosen: row and copies)."""
    own = answers.groupBy("batch").agg(F.collect_list(F.struct("shard", "counts")).alias("answers"))
    joined = batches.select("batch", "sizes", "words", "tokens").join(own, "batch").join(kept, "batch")

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in arrow:
            for b in _opened(record):
                vocabulary, sizes = from_sorted_bytes(b["words"]), unsqueeze(b["sizes"], np.int32).astype(np.int64)
                at = np.cumsum(unsqueeze(b["tokens"], np.int32), dtype=np.int32)
                parts = sorted(b["answers"], key=lambda a: a["shard"])
                df = np.concatenate([unsqueeze(a["counts"], np.int32) for a in parts])
                copies = np.zeros(len(sizes), np.int64)
                for c in b["chosen"]:
                    copies[c["row"] - b["batch"]] = c["copies"]
                ends = np.cumsum(sizes)
                alone = df[at] == np.repeat(copies, sizes)
                single = _sums(alone.astype(np.int64), ends)
                need = sizes - -(-sizes * percent // 100) + 1
                out, held = [], 0
                for d in np.flatnonzero((copies > 0) & (single < need) & (sizes > 3)).tolist():
                    span = slice(ends[d] - sizes[d], ends[d])
                    others = at[span][~alone[span]]
                    sigs = signatures(vocabulary[others], df[others], int(single[d]), percent, limits)
                    out.append((b["batch"] + d, int(sizes[d]), int(single[d]), vocabulary[at[span]].tobytes(), sigs.view(np.int64)))
                    held += 8 * (int(sizes[d]) + len(sigs)) + 64
                    if held > NODE_BYTES:
                        yield _cells(out, kinds, names)
                        out, held = [], 0
                yield _cells(out, kinds, names)

    names = ["node", "n", "single", "tokens", "sigs"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    return joined.mapInArrow(run, "node bigint, n int, single int, tokens binary, sigs array<bigint>")


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether sizes and tokens of one's own leave a link possible between two structs."""
    n, m = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    shared = F.least(n - F.col(f"{a}.single"), m - F.col(f"{b}.single"))
    return 100 * shared >= percent * (n + m - shared)


def _near(shared: np.ndarray, n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n + m - shared)


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) that link. A task streams the partners of one node; many partners are several tasks' work."""
    lanes = pairs.groupBy("a").agg(F.ceil(F.count("*") / LANE).cast("int").alias("lanes"))
    sets = nodes.select("node", "tokens")
    partners = (
        pairs.join(lanes, "a").withColumn("lane", F.pmod(F.xxhash64("b"), F.col("lanes")).cast("int")).withColumnRenamed("b", "node")
        .join(sets, "node").select("a", "lane", F.lit(1).alias("kind"), "node", "tokens")
    )
    centres = lanes.withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).withColumn("node", F.col("a")).join(sets, "node")
    dealt = centres.select("a", "lane", F.lit(0).alias("kind"), "node", "tokens").unionByName(partners)
    dealt = dealt.repartition("a", "lane").sortWithinPartitions("a", "lane", "kind")

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.empty(0, np.uint64)
        for batch in arrow:
            a, kind, node = (batch.column(c).to_numpy() for c in ("a", "kind", "node"))
            tokens = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
            found_a, found_b = [], []
            begin = 0
            for stop in [*np.flatnonzero(kind == 0).tolist(), len(a)]:
                if stop > begin:  # partners of the node before
                    sizes = np.array([len(t) for t in tokens[begin:stop]])
                    flat = np.concatenate(tokens[begin:stop])
                    place = np.minimum(np.searchsorted(centre, flat), len(centre) - 1)
                    shared = _sums((centre[place] == flat).astype(np.int64), np.cumsum(sizes))
                    near = begin + np.flatnonzero(_near(shared, sizes, len(centre), percent))
                    found_a.append(a[near])
                    found_b.append(node[near])
                if stop < len(a):
                    centre = tokens[stop]
                begin = stop + 1
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _blocks(grouped: DataFrame, block: int) -> DataFrame:
    """Members (sig, node, n, single, label) once for each pair of blocks they are compared in: lo and hi, and their own block.

    A group of more than one block is cut by size first, in steps of ``SIZE_STEP``: partners lie at most two steps apart.
    """
    def many(n: str) -> Column:
        return F.ceil(F.greatest(F.count("*") / block, F.sum(n) / BLOCK_TOKENS)).cast("int")

    whole = grouped.groupBy("sig").agg(many("n").alias("blocks"))
    step = F.when(F.col("blocks") == 1, 0).otherwise(1 + F.floor(F.log("n") / math.log(SIZE_STEP))).cast("int")
    stepped = grouped.join(whole, "sig").withColumn("step", step).drop("blocks")
    parts = stepped.groupBy("sig", "step").agg(many("n").alias("parts"))
    placed = stepped.join(parts, ["sig", "step"]).withColumn("own", F.shiftleft("step", 20) + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    apart = placed.drop("parts").withColumn("apart", F.explode(F.array(*map(F.lit, range(-2, 3)))))
    reach = apart.withColumn("step", F.col("step") + F.col("apart")).join(parts, ["sig", "step"])
    other = F.shiftleft("step", 20) + F.col("part")
    met = reach.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("sig", "node", "n", "single", "label", "own", F.least("own", other).alias("lo"), F.greatest("own", other).alias("hi"))


def _with_partners(blocks: DataFrame, percent: int) -> DataFrame:
    """Those members of blocks that sizes and tokens of their own leave a possible partner of another label; narrow rows, before any set moves."""

    def run(table: pa.Table) -> pa.Table:
        n, single, label, own = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "single", "label", "own"))
        crossing = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        keep = np.zeros(len(n), bool)
        for i in range(len(n)):
            possible = _near(np.minimum(n[i] - single[i], n - single), n[i], n, percent) & (label != label[i])
            keep[i] = (possible & (own != own[i])).any() if crossing else possible.any()
        return table.filter(pa.array(keep)).select(["sig", "lo", "hi", "own", "node", "label"])

    return blocks.groupBy("sig", "lo", "hi").applyInArrow(run, "sig bigint, lo int, hi int, own int, node bigint, label bigint")


def block_links(grouped: DataFrame, nodes: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links between members (sig, node, n, single, label) of different labels of large groups: each block of a group meets each of about its size."""
    met = keep(_with_partners(_blocks(grouped, block), percent), "join-large")
    if met.isEmpty():
        return met.select(F.col("node").alias("a"), F.col("node").alias("b"))
    # the sets of those that are left travel, not all
    sets = nodes.select("node", "single", "tokens").join(met.select("node").distinct(), "node", "left_semi")
    dealt = met.join(keep(sets, "join-sets"), "node").select("sig", "lo", "hi", "own", "node", "label", "single", "tokens")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        own, node, label, single = (table.column(c).to_numpy() for c in ("own", "node", "label", "single"))
        crossing = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        tokens = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        sizes = np.array([len(t) for t in tokens])
        _, slot = np.unique(np.concatenate(tokens), return_inverse=True)
        owner = np.repeat(np.arange(len(node)), sizes)
        by_slot = np.argsort(slot, kind="stable")
        begin = np.searchsorted(slot[by_slot], np.arange(slot.max() + 2))
        posting, ends = owner[by_slot], np.cumsum(sizes)
        a, b = [], []
        for i in range(len(node)):
            later = np.arange(i + 1, len(node))
            most = np.minimum(sizes[i] - single[i], sizes[later] - single[later])
            use = (label[later] != label[i]) & _near(most, sizes[i], sizes[later], percent)
            if crossing:
                use &= own[later] != own[i]
            later = later[use]
            if not len(later):
                continue
            mine = slot[ends[i] - sizes[i] : ends[i]]
            length = begin[mine + 1] - begin[mine]
            at = np.repeat(begin[mine] - np.cumsum(length) + length, length) + np.arange(length.sum())
            shared = np.bincount(posting[at], minlength=len(node))[later]
            near = later[_near(shared, sizes[i], sizes[later], percent)]
            a.append(np.full(len(near), node[i]))
            b.append(node[near])
        empty = np.empty(0, np.int64)
        return pa.table({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])})

    return dealt.groupBy("sig", "lo", "hi").applyInArrow(run, "a bigint, b bigint").distinct()


def _relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after links (a, b): labels that are linked become the least of them."""
    ends = links.join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    merged = classes(ends).select(F.col("node").alias("label"), F.col("class_id").alias("new"))
    return keep(label.join(merged, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "join-labels")


def link_classes(nodes: DataFrame, percent: int = PERCENT, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(node, label) of the nodes that share a signature with another: the label is the least node linked, directly or not."""
    indexed = nodes.select(F.explode("sigs").alias("sig"), F.struct("node", "n", "single").alias("x"))
    groups = indexed.groupBy("sig").agg(
        F.count("*").alias("size"), F.min("x").alias("least"), F.max("x").alias("most"),
        F.bit_xor(F.xxhash64("x.node")).alias("f1"), F.bit_xor(F.xxhash64("x.node", F.lit(1))).alias("f2"),
    ).where("size > 1")
    # signatures of the same nodes are one group
    groups = groups.groupBy("size", "least", "most", "f1", "f2").agg(F.min("sig").alias("sig")).drop("f1", "f2")
    grouped = keep(indexed.join(groups, "sig"), "join-groups")
    ends = grouped.withColumn("h", F.explode(F.array("least", "most"))).where("h.node <> x.node").where(_possible("h", "x", percent))
    hubs = ends.select(F.least("h.node", "x.node").alias("a"), F.greatest("h.node", "x.node").alias("b"))
    # a node that many meet is the centre of its pairs: their sets are streamed past it
    hubs = keep(hubs.distinct(), "join-pairs")
    label = grouped.select(F.col("x.node").alias("node")).distinct().withColumn("label", F.col("node"))
    label = _relabelled(label, keep(verified(hubs, nodes, percent), "join-links"))

    def mixed(chosen: Column) -> DataFrame:
        """Members of the chosen groups that hold more than one class."""
        named = grouped.where(chosen).select("sig", "size", "x", "least").join(label.withColumnRenamed("node", "id"), F.col("x.node") == F.col("id"))
        open_ = named.groupBy("sig").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p <> q").select("sig")
        return named.join(open_, "sig").select("sig", "size", "x", "least", "label")

    few = mixed(F.col("size") <= small)
    one, two = few.alias("p"), few.alias("q")
    pairs = one.join(two, "sig").where("p.x.node < q.x.node and p.label <> q.label").where(_possible("p.x", "q.x", percent))
    pairs = pairs.select(F.col("p.x.node").alias("a"), F.col("q.x.node").alias("b")).distinct()
    pairs = keep(pairs.join(hubs, ["a", "b"], "left_anti"), "join-pairs")
    if not pairs.isEmpty():
        label = _relabelled(label, keep(verified(pairs, nodes, percent), "join-links"))
    if not grouped.where(F.col("size") > small).isEmpty():
        # groups of the same least node overlap nearly whole: they are one, so that two sets meet once and not for each signature
        turn = F.pmod(F.xxhash64("least.node"), F.lit(16))
        for low, high in ((0, 1), (1, 4), (4, 16)):  # the links of a few groups settle most of the others
            large = keep(mixed((F.col("size") > small) & (turn >= low) & (turn < high)).select(F.col("least.node").alias("sig"), "x.node", "x.n", "x.single", "label").distinct(), "join-large")
            if not large.isEmpty():
                label = _relabelled(label, keep(block_links(large, nodes, percent, block), "join-links"))
    return label


def components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, limits: tuple[int, int] = CLASSES, small: int = SMALL,
               block: int = BLOCK, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``; ``percent`` from 80 to 100."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100: below, short sets have no prefix of combinations")
    spark = docs.sparkSession
    # in buckets, so that the sets stay where they are when their frequencies come back
    batches = keep_bucketed(sets_of(docs, size, batch_bytes), "join-sets", "batch")
    rows = keep(members(batches), "join-rows")
    first = rows.where("n > 0").groupBy("c1", "c2").agg(
        F.min(F.struct("row", "batch")).alias("at"), F.count("*").alias("copies"), F.min("doc_id").alias("least_id")
    ).select("c1", "c2", F.col("at.row").alias("node"), F.col("at.batch").alias("batch"), "copies", "least_id")
    first = keep(first, "join-nodes")
    kept = first.groupBy("batch").agg(F.collect_list(F.struct(F.col("node").alias("row"), "copies")).alias("chosen"))
    total = batches.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_TOKENS))
    answers = keep(frequencies(batches, shards, total), "join-counts")
    nodes = keep(nodes_of(batches, answers, kept, percent, limits), "join-sets")
    for done in (batches, answers):
        discard(done)
    label = link_classes(nodes, percent, small, block)
    named = first.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    ids = named.join(least, "label").select("c1", "c2", "component_id")
    linked = rows.where("n > 0").join(ids, ["c1", "c2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
