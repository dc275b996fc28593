import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gramlode.llm import mtree, negatives
from gramlode.llm.queries import ORACLES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n,dim,spread", [(1, 3, 9), (700, 8, 4), (1500, 16, 60), (400, 2, 0), (30, 0, 1)])
def test_walk_equals_brute_force(n, dim, spread):
    rng = np.random.default_rng(n)
    heads = rng.integers(-spread * 5, spread * 5 + 1, (9, dim))
    vectors = (heads[rng.integers(0, 9, n)] + rng.integers(-spread, spread + 1, (n, dim))).astype(float)
    ids, labels = rng.permutation(n * 2)[:n].astype(np.int64), rng.integers(0, 3, n).astype(np.int64)
    shard = negatives.Shard(ids, labels, vectors)
    asks = rng.choice(n, min(n, 60), replace=False)
    centres = negatives.centres_of(vectors[asks], 6) if dim else np.zeros((1, 0))
    unit, _ = negatives.directions(vectors[asks])
    cluster = (unit @ centres.T).argmax(1)
    used = 0
    for c in range(len(centres)):
        own = asks[cluster == c]
        if not len(own):
            continue
        shard.sort_for(centres[c], max(negatives.angles(unit[cluster == c], centres[c])) + negatives.SLACK)
        for same in (True, False):
            products = vectors[own] @ vectors.T
            lo = np.where(rng.random(len(own)) < 0.5, -np.inf, np.quantile(products, 0.8, axis=1).round())
            hi = np.where(rng.random(len(own)) < 0.5, np.inf, lo + 40)
            got, computed = shard.walk(ids[own], labels[own], lo, hi, vectors[own], same, 4, step=16)
            used += computed
            for k, row in enumerate(own):
                rows = [(int(s), int(i)) for s, i, x in zip(products[k], ids, labels, strict=True)
                        if i != ids[row] and (x == labels[row]) == same and lo[k] <= s <= hi[k]]
                assert got[k] == sorted(rows, key=lambda e: (-e[0], e[1]))[:4]
    if spread == 60:
        assert used < 0.8 * 2 * len(asks) * n  # walks end early


def brute(rows):
    """Result rows from (id, label, vector) by comparing all."""
    out = []
    clean = {}
    for i, x, v in {(i, x, tuple(np.floor(256 * np.float32(v).astype(float)))) for i, x, v in rows
                    if i is not None and x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}:
        clean.setdefault(len(v), []).append((i, x, v))
    for own in clean.values():
        for i, label, v in own:
            if i % 100:
                continue
            scored = sorted(((-int(np.dot(v, w)), j, x) for j, x, w in own if j != i), key=lambda e: e[:2])
            for s, p, _ in [e for e in scored if e[2] == label][:5]:
                fit = [(j, -t) for t, j, x in scored if x != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
                out += [(i, p, r + 1, j, -s, t) for r, (j, t) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"shard": 60, "block": 3, "sample": 7}])
def test_table(spark, options):
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(4, 6))
    rows = [(int(i), int(rng.integers(0, 4)), (heads[i % 4] + rng.normal(size=6) * 0.4).tolist()) for i in range(-400, 800)]
    rows += [(3000 + i, i % 3, rows[0][2]) for i in range(150)]  # one frequent vector
    rows += [(5000, None, rows[1][2]), (5100, 1, None), (5200, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5300, 2, [float("nan")] * 6), (None, 1, rows[3][2]),
             (5400, 1, [0.5, 0.25]), (5401, 1, [0.5, 0.5]), (5402, 2, [0.5, 0.5]), (5500, 1, []), (5501, 1, []), (5502, 2, []), (5600, 0, [0.0] * 6),
             rows[500], rows[500], (rows[500][0], 1, rows[7][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, score string")
    vectors = df.select("vec_id", "label", mtree.whole_steps(F.col("embedding")).alias("vector"))
    got = negatives.mine(vectors, F.col("vec_id") % 100 == 0, **options)
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, label int, vector array<double>")
    assert negatives.mine(df, F.lit(True)).collect() == []
    df = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], "vec_id long, label int, vector array<double>")
    assert negatives.mine(df, F.lit(False)).collect() == []


def test_query_equals_its_sql(spark):
    name = "op11_shared_list_negatives"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    columns = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    want = sorted(con.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall())
    got = entry.queries()[name](spark, SF).select(*columns.split(", ")).collect()
    assert sorted(map(tuple, got)) == want
