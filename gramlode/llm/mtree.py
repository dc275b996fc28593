"""Exact top-k inner products by best-first search in M-trees.

Vectors get one more component so that all have the norm of the longest; then the Euclidean distance d between a query
(with 0 there) and a vector falls as their inner product rises, and the tree works in that metric. A tree is a set of pages of
at most ``PAGE`` entries. An entry of an inner page has a pivot, the covering radius of its subtree and its distance to
the pivot of the page; an entry of a leaf is a vector with that distance. The search opens the page with the least lower
bound first; the queries of a block do so in step. An entry is passed over without computing its distance when the triangle
inequality on the stored parent distances, |d(q, p) - d(e, p)| - radius, already exceeds the k-th best distance; a page when d(q, pivot) - radius does.
Bounds are widened by rounding errors; scores are exact integers, and ties at the k-th place are kept until
decided, so results are exact.

Vectors are dealt by a hash of their ids to shards of about ``SHARD`` vectors, a tree each. Queries go to all shards in blocks; a
shard's best k for each query are merged. One task holds one tree and one block of queries.

A vector that is null or holds a null or non-finite component takes no part, nor does one whose id is null. Vectors of different lengths do not
meet; empty ones score 0 with each other. A query that is repeated counts once; candidates that are repeated are
all listed. A candidate with the query's id is not a candidate.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlode.llm.common import keep, small_batches

PAGE = 64
SHARD = 8192
BLOCK = 256
BLOCKS_PER_TASK = 64


class Page:
    """Entries with their distance to the page's pivot; inner ones with covering radii and child pages."""

    __slots__ = ("vectors", "ids", "parent", "radius", "child")

    def __init__(self, vectors, ids, parent, radius=None, child=None):
        self.vectors, self.ids, self.parent, self.radius, self.child = vectors, ids, parent, radius, child


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, seed: int = 0):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        norms = (vectors * vectors).sum(1)
        self.norm2 = float(norms.max(initial=0.0))
        self.pages: list[Page] = []
        self.scale = max(1.0, self.norm2)
        lifted = np.hstack([vectors, np.sqrt(np.maximum(self.norm2 - norms, 0))[:, None]])
        rng = np.random.default_rng(seed)
        self.root = self._load(np.arange(len(ids)), ids, vectors, lifted, np.zeros(lifted.shape[1]), page, rng)

    def _load(self, rows, ids, vectors, lifted, pivot, page, rng) -> int:
        """Bulk loading: rows go to the nearest of some pivots, and each group becomes a child page."""
        parent = np.sqrt(((lifted[rows] - pivot) ** 2).sum(1))
        if len(rows) <= page:
            self.pages.append(Page(vectors[rows], ids[rows], parent))
            return len(self.pages) - 1
        n = int(min(page, -(-len(rows) // max(2, page // 2))))
        seeds = rng.choice(rows, n, replace=False)
        near = (lifted[rows] ** 2).sum(1)[:, None] - 2 * lifted[rows] @ lifted[seeds].T + (lifted[seeds] ** 2).sum(1)[None, :]
        group = near.argmin(1)
        if len(np.unique(group)) == 1:  # all alike: cut anyhow
            group = np.arange(len(rows)) * n // len(rows)
        centres, at, radius, child = [], [], [], []
        for g in np.unique(group):
            own = rows[group == g]
            centre = lifted[own].mean(0)
            centres.append(centre)
            at.append(np.sqrt(((centre - pivot) ** 2).sum()))
            radius.append(np.sqrt(((lifted[own] - centre) ** 2).sum(1)).max())
            child.append(self._load(own, ids, vectors, lifted, centre, page, rng))
        self.pages.append(Page(np.array(centres), None, np.array(at), np.array(radius), np.array(child)))
        return len(self.pages) - 1

    def search(self, query: np.ndarray, own_id: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id), ties to smaller ids; and how many distances were computed."""
        q2 = float(query @ query)
        lifted = np.append(query, 0.0)
        slack = 1e-6 * np.sqrt(self.scale + q2)
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
        worst = np.inf  # distance of the k-th best
        queue = [(0.0, 0, self.root, np.sqrt(q2))]  # the root's pivot is the origin
        computed = n = 0
        while queue:
            bound, _, number, to_pivot = heapq.heappop(queue)
            if bound > worst + slack:
                break
            page = self.pages[number]
            gap = np.abs(to_pivot - page.parent)
            if page.child is None:
                use = np.flatnonzero(gap <= worst + slack)
                computed += len(use)
                scores = page.vectors[use] @ query
                if len(best) == k:
                    good = scores >= best[0][0]
                    use, scores = use[good], scores[good]
                for s, i in zip(scores.tolist(), page.ids[use].tolist(), strict=True):
                    if i == own_id:
                        continue
                    entry = (int(s), -i)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    worst = np.sqrt(max(0.0, q2 + self.norm2 - 2 * best[0][0]))
            else:
                use = np.flatnonzero(gap - page.radius <= worst + slack)
                computed += len(use)
                to = np.sqrt(((page.vectors[use] - lifted) ** 2).sum(1))
                bounds = np.maximum(to - page.radius[use], 0)
                for b, d, c in zip(bounds.tolist(), to.tolist(), page.child[use].tolist(), strict=True):
                    if b <= worst + slack:
                        n += 1
                        heapq.heappush(queue, (b, n, c, d))
        return sorted(((s, -i) for s, i in best), key=lambda e: (-e[0], e[1])), computed

    def search_block(self, queries: np.ndarray, own_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query's place, id, score) of the k best of each query, best first; and how many distances were computed.

        The queries search in step: in each round every query opens its next pages in order of their bounds, twice as many as
        in the round before, and a page that several ask for is opened once, with one matrix product.
        """
        q2 = (queries * queries).sum(1)
        norms = np.sqrt(self.scale + q2)
        # products of matrices round more than differences do where two points nearly meet
        slack = max(1e-6, 4 * np.sqrt(queries.shape[1] * np.finfo(float).eps)) * norms
        worst = np.full(len(queries), np.inf)  # distance of the k-th best
        last = np.full((len(queries), 2), -np.inf)  # score and negative id of the k-th best
        none = np.zeros(0, np.int64)
        of, ids, scores = none, none, np.zeros(0)  # the best so far
        asks, pages, bounds, away = np.arange(len(queries)), np.full(len(queries), self.root), np.zeros(len(queries)), np.sqrt(q2)
        computed, width = 0, 1
        while len(asks):
            order = np.lexsort((bounds, asks))
            asks, pages, bounds, away = asks[order], pages[order], bounds[order], away[order]
            now = np.arange(len(asks)) - np.searchsorted(asks, asks) < width
            waiting = [(asks[~now], pages[~now], bounds[~now], away[~now])]
            by_page = np.flatnonzero(now)[np.argsort(pages[now], kind="stable")]
            found = [(of, ids, scores)]
            for opened in np.split(by_page, np.flatnonzero(np.diff(pages[by_page])) + 1):
                page, q, to_pivot = self.pages[pages[opened[0]]], asks[opened], away[opened]
                limit = (worst + slack)[q, None]
                near = np.abs(to_pivot[:, None] - page.parent) - (0 if page.child is None else page.radius) <= limit
                use = np.flatnonzero(near.any(0))
                near = near[:, use]
                computed += int(near.sum())
                if page.child is None:
                    score, mine = queries[q] @ page.vectors[use].T, page.ids[use]
                    least = last[q]
                    good = (score > least[:, :1]) | (score == least[:, :1]) & (-(mine.astype(float)) >= least[:, 1:])
                    row, entry = np.nonzero(good & near & (mine != own_ids[q, None]))
                    found.append((q[row], mine[entry], score[row, entry]))
                else:
                    pivots = page.vectors[use]
                    to = q2[q, None] + (pivots * pivots).sum(1) - 2 * (queries[q] @ pivots[:, :-1].T)
                    to = np.sqrt(np.maximum(to, 0))
                    bound = np.maximum(to - page.radius[use], 0)
                    row, entry = np.nonzero(near & (bound <= limit))
                    waiting.append((q[row], page.child[use][entry], bound[row, entry], to[row, entry]))
            of, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((ids, -scores, of))
            of, ids, scores = of[order], ids[order], scores[order]
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            full = rank == k - 1
            worst[of[full]] = np.sqrt(np.maximum(0, q2[of[full]] + self.norm2 - 2 * scores[full]))
            last[of[full]] = np.stack([scores[full], -(ids[full].astype(float))], 1)
            of, ids, scores = of[rank < k], ids[rank < k], scores[rank < k]
            asks, pages, bounds, away = (np.concatenate(x) for x in zip(*waiting, strict=True))
            open_still = bounds <= (worst + slack)[asks]
            asks, pages, bounds, away = asks[open_still], pages[open_still], bounds[open_still], away[open_still]
            width *= 2
        return of, ids, scores, computed


def whole_steps(embedding: Column, steps: int = 256) -> Column:
    """Each component x as floor(steps * x); null where a component is null or not finite."""
    fine = F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(steps * x.cast("double")).cast("double")))


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, page: int = PAGE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, vector array<double>) that are queries."""
    spark = vectors.sparkSession
    small_batches(spark)
    clean = vectors.where("vec_id is not null and vector is not null").select("vec_id", "vector", F.size("vector").alias("dim"))
    clean = keep(clean.withColumn("query", F.coalesce(is_query, F.lit(False))), "vectors")
    total = clean.count()
    shards, dealt = max(1, -(-total // shard)), F.pmod(F.xxhash64("vec_id", "vector"), F.lit(2**31))
    candidates = clean.select("dim", (dealt % shards).cast("int").alias("shard"), "vec_id", "vector")

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tree = MTree(table.column("vec_id").to_numpy(), matrix(table.column("vector").combine_chunks()), page)
        return pa.table({
            "dim": table.column("dim")[:1], "shard": table.column("shard")[:1],
            "payload": pa.array([pickle.dumps(tree)], pa.binary()),
        })

    trees = keep(candidates.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, payload binary"), "trees")
    queries = clean.where("query").select("dim", "vec_id", "vector").distinct()
    n_blocks = max(1, -(-queries.count() // block))
    blocks = queries.withColumn("block", (F.pmod(F.xxhash64("vec_id", "vector"), F.lit(2**31)) % n_blocks).cast("int"))
    blocks = blocks.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
    # every block meets every tree; a task takes one tree and a run of blocks
    runs = -(-n_blocks // BLOCKS_PER_TASK)
    asked = "array<struct<vec_id: bigint, vector: array<double>>>"
    tree_rows = trees.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).selectExpr(
        "dim", "shard", "run", "0 AS kind", "0 AS block", "payload", f"CAST(NULL AS {asked}) AS queries"
    )
    query_rows = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).selectExpr(
        "dim", "shard", f"CAST(block DIV {BLOCKS_PER_TASK} AS int) AS run", "1 AS kind", "block", "CAST(NULL AS binary) AS payload", "queries"
    )
    dealt = tree_rows.unionByName(query_rows)
    dealt = dealt.repartition(max(1, shards * runs), "dim", "shard", "run").sortWithinPartitions("dim", "shard", "run", "kind", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                place = tuple(batch.column(c)[row].as_py() for c in ("dim", "shard", "run"))
                if batch.column("kind")[row].as_py() == 0:
                    tree, at = pickle.loads(batch.column("payload")[row].as_py()), place
                    continue
                if at != place:  # a shard without vectors of this length
                    continue
                asked = batch.column("queries")[row].values
                vectors = np.asarray(asked.field("vector").flatten(), np.float64).reshape(len(asked), -1)
                ids = asked.field("vec_id").to_numpy()
                number, found, scores, _ = tree.search_block(vectors, ids, k)
                block = batch.column("block")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[number], pa.int64()), pa.array(np.full(len(number), place[0]), pa.int32()), pa.array(np.full(len(number), block), pa.int32()),
                     pa.array(number, pa.int32()), pa.array(found, pa.int64()), pa.array(scores.astype(np.int64))],
                    ["query_id", "dim", "block", "number", "vec_id", "score"],
                )

    # block and number tell queries that share an id apart
    found = dealt.mapInArrow(search, "query_id bigint, dim int, block int, number int, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "dim", "block", "number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
