import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gramlode.llm import simhash


def corpus():
    rng = random.Random(8)
    vocab = ["w%d" % k for k in range(900)]
    rows = [(k * 3, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 400)))) for k in range(80)]
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "é" * 9), (1004, rows[5][1]), (None, rows[6][1]), (9, "again"), (9, "again"), (9, "about"),
             (2000, "echo " * 3000)]
    return rows


def brute(rows):
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64(r[1].encode(), seed=42).intdigest()).view(np.int64)))
    out = []
    for i, (k, t) in enumerate(order):
        f = order[(i + 1) % len(order)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + f[:q]
        prints = [p.tobytes().hex() for p in simhash.fingerprints([t, e, f])]
        like = [1 - bin(int(prints[0], 16) ^ int(p, 16)).count("1") / 128 for p in prints[1:]]
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), prints[0], prints[1], *like))
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_rows(spark, partitions):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_chars string")
    got = simhash.edited(docs, partitions)
    assert got.columns == simhash._NAMES
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    near = {}
    ints = [(w[3], int(w[3], 16)) for w in want]
    for s, x in ints:
        near[s] = sum(bin(x ^ y).count("1") <= simhash.RADIUS for _, y in ints) - 1
    for options in ({}, {"small": 1, "block_rows": 3}):
        for r in simhash.with_neighbours(got, **options).collect():
            assert r.n_near == near[r.fingerprint]


def test_many_rows_of_one_doc_id_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TERMS", 100)
    rows = [(5, f"text number {k % 40} of the one id, said in some words") for k in range(300)] + [(6, "a long one " * 4000), (4, "before")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.edited(docs, 6).collect())) == sorted(brute(rows))


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(4, "a b c d e f g h")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.edited(docs).collect())) == brute([(4, "a b c d e f g h")])
    assert simhash.with_neighbours(simhash.edited(docs.where("false"))).collect() == []


def test_votes_by_brute_force():
    from gramlode.llm.words import mix, shingles, text_bytes, words
    import pyarrow as pa

    texts = ["a b c d e f g a b c d e f g", "x", "", "one two three four five six " * 100]
    got = simhash.fingerprints(texts)
    for w in words(*text_bytes(pa.array(texts))):
        doc, h = shingles(w, 5)
        for d in range(len(texts)):
            votes = [0] * 128
            for x in h[doc == d]:
                bits = f"{int(x):064b}{int(mix(np.array([x ^ np.uint64(0x9E3779B97F4A7C15)]))[0]):064b}"
                for k, b in enumerate(bits):
                    votes[k] += 1 if b == "1" else -1
            assert got[d].tobytes().hex() == f"{int(''.join('1' if v > 0 else '0' for v in votes), 2):032x}"


@pytest.mark.parametrize("radius,blocks", [(3, 4), (2, 4), (0, 4), (5, 8), (6, 8)])
def test_neighbours_equal_brute_force(spark, radius, blocks):
    rng = random.Random(radius)
    ints = [rng.getrandbits(128) for _ in range(40)]
    for x in list(ints):
        for _ in range(3):
            y = x
            for _ in range(rng.randrange(0, radius + 3)):
                y ^= 1 << rng.randrange(128)
            ints.append(y)
    prints = spark.createDataFrame([(f"{x:032x}", 1 + x % 3) for x in set(ints)], "fingerprint string, times long")
    want = {}
    for x in set(ints):
        n = sum(1 + y % 3 for y in set(ints) if y != x and bin(x ^ y).count("1") <= radius)
        if n:
            want[f"{x:032x}"] = n
    for small in (1, 16):
        got = {r.fingerprint: r.n_near for r in simhash.neighbours(prints, radius, blocks, small, 3).collect()}
        assert got == want
