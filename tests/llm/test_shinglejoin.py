import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from gramlode.llm import shinglejoin
from gramlode.llm.queries import ORACLES

SF = "/root/testdata/sf0.001"


def shingle_set(text, size=5):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, percent=80):
    """(doc_id, n, component) of each row by comparing all pairs."""
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            ids[root(i)] = min(ids.get(root(i), k), k)
    return sorted(((k, len(s), ids.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, n=260):
    """Copies, near copies at all distances, shared passages, short texts, and texts of frequent words only."""
    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.35)) % 400}"
    passage, texts = [word() for _ in range(40)], []
    for _ in range(n):
        kind = r.random()
        if kind < 0.35 and texts:
            w = r.choice(texts).split()
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                if w:
                    w[r.randrange(len(w))] = word()
            w = w if r.random() < 0.7 else w[: r.randint(0, len(w))] + [word() for _ in range(r.randint(0, 9))]
        elif kind < 0.55:
            w = passage + [word() for _ in range(r.choice([0, 2, 5, 9, 14]))]
        elif kind < 0.65:
            w = [word() for _ in range(r.randint(0, 8))]
        elif kind < 0.72:
            w = ["a", "b", "c"] * r.randint(1, 12)
        else:
            w = [word() for _ in range(r.randint(10, 120))]
        texts.append(" ".join(w))
    return [(r.randint(0, 2 * n) if r.random() < 0.9 else None, t if t else r.choice([None, "", " \t\n"])) for t in texts]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"limits": (1, 3), "small": 2, "block": 5, "batch_bytes": 900}),
                                          (3, {"limits": (2, 2), "small": 3, "block": 40}), (4, {"limits": (0, 0), "small": 100}),
                                          (5, {"limits": (1, 9), "percent": 90})])
def test_equals_all_pairs(spark, seed, options):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, `a.b` string, n_shingles int")
    got = shinglejoin.components(df, **options).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, options.get("percent", 80))


@pytest.mark.parametrize("limits", [(3, 6), (0, 4), (0, 0), (9, 9)])
def test_linked_sets_share_a_signature(limits):
    """Whatever the frequencies are, two sets at the limit of similarity share a signature."""
    rng = np.random.default_rng(7)
    frequency = rng.integers(1, 10, 5000)
    hashes = np.sort(rng.integers(0, 2**63, 5000).astype(np.uint64))
    linked = 0
    for _ in range(1500):
        n = int(rng.choice([4, 5, 6, 9, 10, 15, 31, 32, 40, 63, 64, 120, 300]))
        shared = int(rng.integers(-(-n * 4 // 5), n + 1))
        pool = rng.permutation(5000)
        mine = pool[:n]
        m = int(rng.integers(shared, shared * 5 // 4 + 1))
        other = np.concatenate([mine[rng.permutation(n)[:shared]], pool[n : n + m - shared]])
        if 100 * shared < 80 * (n + m - shared):
            continue
        linked += 1
        alone = [rng.random(len(x)) < 0.5 for x in (mine, other)]  # of the tokens that the other lacks, some occur nowhere else
        sigs = []
        for x, y, a in ((mine, other, alone[0]), (other, mine, alone[1])):
            use = x[np.isin(x, y) | ~a]
            sigs.append(shinglejoin.signatures(hashes[use], frequency[use], len(x) - len(use), limits=limits))
        assert np.intersect1d(*sigs).size
    assert linked > 400


def test_combinations_stay_linear_in_the_prefix():
    for n in (100, 1000, 20000):
        tokens = np.sort(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        for frequency in (100, 10**6):
            assert len(shinglejoin.signatures(tokens, np.full(n, frequency), 0)) < 6 * n


def test_no_rows_and_wrong_percent(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shinglejoin.components(df).collect() == []
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  ")], "doc_id long, text string")
    assert sorted(map(tuple, shinglejoin.components(df).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    with pytest.raises(ValueError):
        shinglejoin.components(df, percent=79)


def test_query_equals_its_sql(spark):
    name = "op13_shingle_join"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({ORACLES[name]})").fetchall())
    got = entry.queries()[name](spark, SF).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == want
