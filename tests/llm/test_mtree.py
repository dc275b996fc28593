import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlode.llm import mtree


def best(ids, vectors, query, own, k):
    scores = [(int(v @ query), i) for i, v in zip(ids.tolist(), vectors, strict=True) if i != own]
    return sorted(scores, key=lambda e: (-e[0], e[1]))[:k]


@pytest.mark.parametrize("n,dim,spread", [(1, 3, 9), (40, 2, 3), (700, 8, 60), (900, 4, 2), (500, 16, 0)])
def test_search_equals_brute_force(n, dim, spread):
    rng = np.random.default_rng(n)
    centres = rng.integers(-spread * 5, spread * 5 + 1, (12, dim))
    vectors = (centres[rng.integers(0, 12, n)] + rng.integers(-spread, spread + 1, (n, dim))).astype(float)
    ids = rng.permutation(n * 2)[:n].astype(np.int64)
    tree = mtree.MTree(ids, vectors, page=8)
    computed = 0
    for row in range(0, n, 7):
        got, used = tree.search(vectors[row], int(ids[row]), 5)
        computed += used
        assert got == best(ids, vectors, vectors[row], int(ids[row]), 5)
    if spread == 60:
        assert computed < 0.8 * n * len(range(0, n, 7))  # bounds save distances


@pytest.mark.parametrize("n,dim,spread", [(1, 3, 9), (700, 8, 60), (900, 4, 2), (500, 16, 0), (6, 0, 1)])
def test_a_block_of_queries_shares_pages(n, dim, spread):
    rng = np.random.default_rng(n)
    vectors = rng.integers(-spread, spread + 1, (n, dim)).astype(float)
    ids = rng.permutation(n * 2)[:n].astype(np.int64)
    ids[-1] = -(2**63)

    class Opened(list):
        times = 0

        def __getitem__(self, number):
            self.times += 1
            return super().__getitem__(number)

    tree = mtree.MTree(ids, vectors, page=8)
    tree.pages = Opened(tree.pages)
    for k in (1, 5, 40):
        tree.pages.times = 0
        place, found, scores, computed = tree.search_block(vectors, ids, k)
        for row in range(n):
            mine = place == row
            assert list(zip(scores[mine].tolist(), found[mine].tolist(), strict=True)) == best(ids, vectors, vectors[row], int(ids[row]), k)
        if n > 100:  # a query each opens some of the pages, all of them together few more than there are
            assert tree.pages.times < 12 * len(tree.pages) < n * len(tree.pages) / 8


def test_blocks_go_through_the_tree_together(spark, monkeypatch):
    monkeypatch.setattr(mtree.MTree, "search", None)  # one query at a time
    rows = [(i, [float(i % 17), float(i % 5)]) for i in range(300)]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, vector array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert len(got) == 30


def test_table(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.normal(size=6) * 0.3).tolist(), "x") for i in range(-100, 300)]
    rows += [(400 + i, rows[0][1], "x") for i in range(60)] + [(500, None, "x"), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (502, [float("nan")] * 6, "x"),
             (503, [float("inf")] + [0.0] * 5, "x"), (None, rows[3][1], "x"), (550, [0.5, 0.25], "x"), (551, [0.5, 0.5], "x"), (600, [], "x"),
             (601, [], "x"), (50, rows[150][1], "x"), (650, rows[0][1], "x"), (650, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    vectors = df.select("vec_id", mtree.whole_steps(F.col("embedding")).alias("vector"))
    clean = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            clean.setdefault(len(v), []).append((i, np.floor(256 * np.float32(v).astype(float))))
    want = []
    for own in clean.values():
        ids, matrix = np.array([i for i, _ in own]), [v for _, v in own]
        for i, q in {(i, tuple(v)) for i, v in own if i % 50 == 0}:
            want += [(i, r + 1, v, s) for r, (s, v) in enumerate(best(ids, matrix, np.array(q), i, 5))]
    for options in ({}, {"shard": 50, "block": 3, "page": 4}):
        got = mtree.top_k(vectors, F.col("vec_id") % 50 == 0, **options)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert mtree.top_k(vectors.where("false"), F.lit(True)).collect() == []
