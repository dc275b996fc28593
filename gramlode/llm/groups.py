"""Classes of linked nodes: connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import keep

ROUNDS = 60
TASK_EDGES = 1 << 18  # so few edges need no shuffle: a round of them is one task


def _stars(edges: DataFrame, large: bool, few: bool = False) -> DataFrame:
    """One contraction: neighbours move to the least neighbour. Groups are only ever aggregated, and joined."""

    def dealt(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    if large:
        both = dealt(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    else:  # each node with its smaller neighbours
        both = dealt(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.join(least, "a")
    if large:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return dealt(out.where("a <> b")).distinct()


def classes(edges: DataFrame) -> DataFrame:
    """(node, class_id): the least node that each node of ``edges`` (a, b) is linked to, directly or not.

    Loops and repeated edges do no harm; nodes without edges are not listed. Each round is written to the shared
    folder, so that a lost executor costs one round at most.
    """
    now = keep(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(ROUNDS):
        size = now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(size) == seen or not size[0]:
            break
        seen, few = tuple(size), size[0] <= TASK_EDGES
        now = keep(_stars(_stars(now, True, few), False, few), "edges")
    else:
        raise RuntimeError(f"links did not settle in {ROUNDS} rounds")
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("class_id"))
    return pairs.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("class_id")).distinct())
