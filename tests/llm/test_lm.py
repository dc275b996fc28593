import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gramlode.llm import lm

SF = "/root/testdata/sf0.001"
END = ("end",)


def tokens(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), END]


def brute(rows, model):
    """Scores by dictionaries, with the weights of ``model``."""
    uni, bi = Counter(), Counter()
    for _, t, fit in rows:
        if fit:
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["start", *w], w, strict=False))
    n, v, docs = uni.total(), len(uni), uni[END]
    out = []
    for k, t, fit in rows:
        base = score = 0.0
        w = tokens(t)
        for h, x in zip(["start", *w], w, strict=False):
            c = docs if h == "start" else uni[h]
            base += math.log10((uni[x] + 1) / (n + v + 1))
            b = int(math.log2(c)) + 1 if c else 0
            p = [1 / (v + 1), uni[x] / max(n, 1), bi[h, x] / c if c else 0]
            score += math.log10(sum(a * q for a, q in zip(model.weights[b], p, strict=True)))
        out.append((k, fit, len(w), sum(x in uni for x in w), base, score))
    return out, n, v


def compare(spark, rows, batch_bytes):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, use boolean, score string")
    batches = lm.keep(lm.batches_of(docs, F.col("use"), batch_bytes), "t")
    answers = lm.keep(lm.counted(batches, 3), "t")
    model = lm.learn(batches, answers)
    want, n, v = brute(rows, model)
    assert (model.n, model.v) == (n, v)
    got = sorted(map(tuple, lm.scored(batches, answers, model).collect()), key=str)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)
    return model, got


@pytest.mark.parametrize("batch_bytes", [200, 1 << 20])
def test_scores_equal_brute_force(spark, batch_bytes):
    text = "the cat sat on the mat the dog sat on The log"
    rows = [(k, " ".join(text.split()[k % 5 :]), k % 3 != 0) for k in range(40)]
    rows += [(50, None, True), (51, "", False), (52, "unseen Words ONLY", False), (None, "the é É cat", True), (1, "the cat", True), (1, "the cat", True),
             (53, "echo " * 2000, True)]
    model, _ = compare(spark, rows, batch_bytes)
    assert np.allclose(model.weights.sum(1), 1, atol=1e-9)


def test_without_training_texts_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score(docs, F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.base_score, r.train_tokens) for r in sorted(got)] == [(3, 0, 0.0, 0), (1, 0, 0.0, 0)]
    assert all(abs(r.score) < 1e-6 for r in got)
    assert lm.score(docs.where("false"), F.lit(True)).collect() == []


def test_weights_find_the_better_estimate():
    p2 = lambda p: int(round(-lm.STEPS_PER_OCTAVE * math.log2(p))) + 1 if p else 0
    cells = {(5, p2(1e-4), p2(0.5)): 900, (5, p2(1e-2), 0): 100, (2, p2(1e-2), p2(0.01)): 50, (2, p2(1e-3), 0): 950}
    cell = np.array([(b * 512 + a) * 512 + c for b, a, c in cells])
    w = lm.weights_of(cell, np.array(list(cells.values()), float), 2, 10000, 15)
    assert w[5, 2] > 0.85 and w[2, 2] < 0.1 and w[0, 2] < 1e-9


def test_query_beats_the_base_on_held_out_texts(spark):
    got = entry.queries()["op1_deleted_interpolation"](spark, SF).collect()
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    counts = Counter(x for k, t in rows if not held[k] for x in tokens(t))
    n, v, by_id = counts.total(), len(counts), dict(rows)
    assert len(got) == len(rows)
    for r in got:
        w = tokens(by_id[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in counts for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_order_three_and_one(spark):
    docs = spark.createDataFrame([(k, "a b c d a b c e a b") for k in range(9)], "doc_id long, text string")
    totals = [sum(r.score for r in lm.score(docs, F.col("doc_id") > 2, order=n).collect()) for n in (1, 2, 3)]
    assert totals[0] < totals[1] < totals[2]
