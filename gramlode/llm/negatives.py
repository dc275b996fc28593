"""Hard negatives by anchor-clustered shared lists.

An anchor's *positives* are the rows of its label with the highest inner products; the *negatives* of an anchor and a positive are the
highest rows of other labels whose score lies in a window below the positive's. Both are *asks*: an anchor, a label rule and a
window [lo, hi] of scores, of which the best k are wanted, ties to smaller ids.

Anchors are clustered by direction. For a cluster with centre c, whose members are at most an angle b away from it, the inner product of
a member u with a candidate i is at most |u| |i| cos(max(0, angle(i, c) - b)). So candidates are sorted once for each
cluster by |i| cos(max(0, angle(i, c) - b)); every member walks that one list from the top, and stops, certified, when |u| times
the next bound is below its k-th best score or below lo. Bounds are widened by rounding errors, scores are exact integers: results are
exact, whatever the clusters.

Candidates are dealt to shards of about ``SHARD`` vectors by a hash of their row; a shard has a list for each cluster. Asks travel to all
shards in blocks of about ``BLOCK``, and a shard's best are merged by rank. One task holds one shard and one block. Centres are
fitted to a sample of at most ``SAMPLE`` anchors (those first by a hash); all anchors are assigned.

A row with a null id, label or vector, or with a null or non-finite component, takes no part. Equal rows (id, label, vector) count once; rows
that share an id are no candidates of each other. Vectors of different lengths do not meet; empty ones score 0. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlode.llm.common import keep, small_batches

POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100  # percent of the positive's score
SHARD = 4096
BLOCK = 256
BLOCKS_PER_TASK = 64
SAMPLE = 4096
MEMBERS, CLUSTERS = 24, 256
STEP = 256
SLACK = 1e-6
_ASK = "array<struct<ask: bigint, vec_id: bigint, label: bigint, lo: double, hi: double, vector: array<double>>>"


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms; of a zero vector the first axis."""
    norms = np.sqrt((vectors * vectors).sum(1))
    unit = vectors / np.where(norms > 0, norms, 1)[:, None]
    if vectors.shape[1]:
        unit[norms == 0, 0] = 1
    return unit, norms


def centres_of(sample: np.ndarray, count: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means."""
    unit, _ = directions(sample)
    unit = np.unique(unit, axis=0)
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), min(count, len(unit)), replace=False)]
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        filled = np.bincount(near, minlength=len(centres)) > 0
        centres[filled] = directions(sums[filled])[0]
    return centres


def angles(unit: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centre, -1, 1)) if unit.shape[1] else np.zeros(len(unit))


class Shard:
    """Some candidates, and for the cluster at hand their order by bound."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.unit, self.norms = directions(self.vectors)

    def sort_for(self, centre: np.ndarray, widest: float) -> None:
        """The list of a cluster whose members are at most ``widest`` away from its centre."""
        bound = self.norms * np.minimum(1, np.cos(np.maximum(0, angles(self.unit, centre) - widest)) + SLACK)
        order = np.argsort(-bound, kind="stable")
        self.list_ids, self.list_labels, self.list_vectors = self.ids[order], self.labels[order], self.vectors[order]
        self.bound = np.append(bound[order], -np.inf)

    def walk(self, ids, labels, lo, hi, vectors, same: bool, k: int, step: int = STEP) -> tuple[list[list[tuple[int, int]]], int]:
        """For each ask its best k (score, id), and how many inner products were computed."""
        norms = np.sqrt((vectors * vectors).sum(1))
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        floor, active, computed = lo.copy(), np.arange(len(ids)), 0
        for at in range(0, len(self.list_ids), step):
            active = active[norms[active] * self.bound[at] + SLACK >= floor[active]]
            if not len(active):
                break
            part = slice(at, at + step)
            scores = vectors[active] @ self.list_vectors[part].T
            computed += scores.size
            fit = (self.list_labels[part][None, :] == labels[active][:, None]) == same
            fit &= (scores >= floor[active][:, None]) & (scores <= hi[active][:, None])
            fit &= self.list_ids[part][None, :] != ids[active][:, None]
            for row in np.flatnonzero(fit.any(1)):
                own, use = active[row], np.flatnonzero(fit[row])
                found = zip((-scores[row, use]).astype(np.int64).tolist(), self.list_ids[part][use].tolist(), strict=True)
                best[own] = sorted([*best[own], *found])[:k]
                if len(best[own]) == k:
                    floor[own] = max(lo[own], -best[own][-1][0])  # an equal score may have a smaller id
        return [[(-s, i) for s, i in found] for found in best], computed


def _floor_percent(whole: Column) -> Column:
    """Of an integer, the hundredth rounded down."""
    return ((whole - F.pmod(whole, F.lit(100))) / 100).cast("bigint")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def shards_of(clean: DataFrame, shards: int) -> DataFrame:
    """(dim, shard, ids, labels, vectors): the candidates dealt out."""

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        columns = [table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label")]
        columns.append(_matrix(table.column("vector").combine_chunks()).tobytes())
        return pa.table({
            "dim": table.column("dim")[:1], "shard": table.column("shard")[:1],
            **{n: pa.array([c], pa.binary()) for n, c in zip(("ids", "labels", "vectors"), columns, strict=True)},
        })

    dealt = clean.select("dim", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "label", "vector")
    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, ids binary, labels binary, vectors binary")


def clustered(anchors: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The anchors with cluster and angle to its centre, and the centres by vector length."""
    total = anchors.count()
    some = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("dim", "vector").toArrow()
    dims = some.column("dim").to_numpy()
    centres: dict[int, np.ndarray] = {}
    for dim in np.unique(dims):
        own = _matrix(some.filter(pa.array(dims == dim)).column("vector").combine_chunks())
        count = min(CLUSTERS, max(1, total * len(own) // (MEMBERS * max(1, len(dims)))))
        centres[int(dim)] = centres_of(own, count) if dim else np.zeros((1, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, angle = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            lengths = batch.column("dim").to_numpy()
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                unit, _ = directions(_matrix(batch.column("vector").take(pa.array(rows))))
                own = centres.get(int(dim), np.eye(1, int(dim)))
                if dim:
                    cosines = unit @ own.T
                    cluster[rows] = cosines.argmax(1)
                    angle[rows] = np.arccos(np.clip(cosines.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(angle)], [*batch.schema.names, "cluster", "angle"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
    return anchors.mapInArrow(assign, f"{fields}, cluster int, angle double"), centres


def answered(asks: DataFrame, n_asks: int, shards: DataFrame, n_shards: int, centres: dict[int, np.ndarray], same: bool, k: int, block: int = BLOCK) -> DataFrame:
    """(ask, place, vec_id, score): the best k of each ask (ask, vec_id, label, lo, hi, vector, dim, cluster, widest); place counts from 1."""
    counts = asks.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    blocks = (
        asks.join(counts, ["dim", "cluster"]).withColumn("block", F.pmod(F.xxhash64("ask"), F.col("blocks")).cast("int"))
        .groupBy("dim", "cluster", "block", "widest").agg(F.collect_list(F.struct("ask", "vec_id", "label", "lo", "hi", "vector")).alias("asks"))
    )
    runs = max(1, -(-n_asks // (block * BLOCKS_PER_TASK)))
    nothing = "CAST(NULL AS binary)"
    shard_rows = shards.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).selectExpr(
        "dim", "shard", "run", "0 AS kind", "0 AS cluster", "0 AS block", "0D AS widest", "ids", "labels", "vectors", f"CAST(NULL AS {_ASK}) AS asks"
    )
    ask_rows = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).selectExpr(
        "dim", "shard", f"CAST(pmod(xxhash64(cluster, block), {runs}) AS int) AS run", "1 AS kind", "cluster", "block", "widest",
        f"{nothing} AS ids", f"{nothing} AS labels", f"{nothing} AS vectors", "asks",
    )
    dealt = shard_rows.unionByName(ask_rows).repartition(max(1, n_shards * runs), "dim", "shard", "run")
    dealt = dealt.sortWithinPartitions("dim", "shard", "run", "kind", "cluster", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, sorted_for = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                dim, number, run, kind, cluster, widest = (batch.column(c)[row].as_py() for c in ("dim", "shard", "run", "kind", "cluster", "widest"))
                if kind == 0:
                    ids, labels = (np.frombuffer(batch.column(c)[row].as_py(), np.int64) for c in ("ids", "labels"))
                    vectors = np.frombuffer(batch.column("vectors")[row].as_py(), np.float64).reshape(len(ids), dim)
                    shard, at, sorted_for = Shard(ids, labels, vectors), (dim, number, run), None
                    continue
                if at != (dim, number, run):  # a shard without vectors of this length
                    continue
                if sorted_for != cluster:  # once for all members of the cluster
                    shard.sort_for(centres.get(dim, np.eye(1, dim))[cluster], widest + SLACK)
                    sorted_for = cluster
                asked = batch.column("asks")[row].values
                ids, labels, lo, hi = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "lo", "hi"))
                vectors = np.asarray(asked.field("vector").flatten(), np.float64).reshape(len(asked), dim)
                found, _ = shard.walk(ids, labels, lo, hi, vectors, same, k)
                names = asked.field("ask").to_pylist()
                rows = [(a, i, s) for a, own in zip(names, found, strict=True) for s, i in own]
                columns = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["ask", "vec_id", "score"])

    found = dealt.mapInArrow(search, "ask bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("ask", "place", "vec_id", "score")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         shard: int = SHARD, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (vec_id, label, vector of whole doubles) that are anchors."""
    small_batches(vectors.sparkSession)
    rows = vectors.where("vec_id is not null and label is not null and vector is not null")
    rows = rows.select("vec_id", F.col("label").cast("bigint").alias("label"), "vector", F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.distinct().withColumn("dim", F.size("vector")).withColumn("row", F.monotonically_increasing_id())
    clean = keep(rows, "negatives-rows")
    n_shards = max(1, -(-clean.count() // shard))
    shards = keep(shards_of(clean, n_shards), "negatives-shards")
    anchors = clean.where("anchor").select("row", "vec_id", "label", "vector", "dim")
    placed, centres = clustered(anchors, sample)
    placed = keep(placed, "negatives-anchors")
    widest = placed.groupBy("dim", "cluster").agg(F.max("angle").alias("widest"))
    placed = placed.drop("angle").join(widest, ["dim", "cluster"])
    n_anchors = placed.count()
    everything = placed.select(
        F.col("row").alias("ask"), "vec_id", "label", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), "vector", "dim", "cluster", "widest"
    )
    best = answered(everything, n_anchors, shards, n_shards, centres, True, positives, block)
    best = keep(best.select(F.col("ask").alias("row"), F.col("place").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # equal scores share a window; below zero it is empty
    windows = best.where(f"{low} * positive_score <= {high} * positive_score").groupBy("row", "positive_score").agg(F.min("nth").alias("nth"))
    name = F.col("row") * positives + F.col("nth") - 1
    asks = windows.withColumn("ask", name).join(placed, "row").select(
        "ask", "vec_id", "label", (-_floor_percent(-low * F.col("positive_score"))).cast("double").alias("lo"),
        _floor_percent(high * F.col("positive_score")).cast("double").alias("hi"), "vector", "dim", "cluster", "widest",
    )
    found = answered(asks, n_anchors * positives, shards, n_shards, centres, False, negatives, block)
    windows = windows.select("row", "positive_score", name.alias("ask"))
    pairs = best.join(windows, ["row", "positive_score"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return pairs.join(found, "ask").select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
