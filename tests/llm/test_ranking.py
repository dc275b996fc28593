import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gramlode.llm import ranking

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in entry.queries()["op8_bradley_terry"](spark, SF).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[k].predicted, q) for k, q in labels if got[k].held_out]
    for q in (0, 1):
        right = [p == q for p, true in held if true == q]
        assert np.mean(right) >= 0.95, (q, np.mean(right), len(right))


def test_edges(spark):
    rows = [(1, "Some plain words here.", "a", "b"), (2, None, None, None), (3, "", "x", "y"), (None, "@@ ## !!", "x", "z"),
            (1, "Some plain words here.", "a", "b"), (5, "word " * 60000, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, label string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, 0), (2, None), (99, 1), (5, 7)], "doc_id long, quality int")
    ranker = ranking.fit(docs, labels)
    out = ranking.score(docs, ranker).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    assert len({r.score for r in out if not r.text}) == 1
    one = ranking.fit(docs, labels.where("quality = 1"))
    assert {r.score for r in ranking.score(docs, one).collect()} == {0.5}
    assert ranking.score(docs.where("false"), one).collect() == []
    assert {r.score for r in ranking.score(docs, ranking.fit(docs.where("false"), labels)).collect()} == {0.5}


def test_learns_an_order_from_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, ranking.WIDTH)).astype(np.float32)
    label = (x[:, 3] - x[:, 7] > 0).astype(int)
    ranker = ranking.learn(x.copy(), label)
    assert ((ranker.scores(x) >= 0.5) == label).mean() > 0.95


def plain_features(text):
    """The features of a text, counted character by character."""
    raw = (text or "").encode()
    lower, upper, digits = (f"{s}" for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
    marks = sorted({*range(0x20, 0x7F)} - {ord(c) for c in lower + upper + digits})

    def kind(b):
        if b >= 0x80:
            return 1 if b < 0xC0 else 2
        if b == 0x0A:
            return 39
        c = chr(b)
        return 3 if c in lower else 4 if c in upper else 5 if c in digits else 6 + marks.index(b) if b in marks else 0

    kinds = [kind(b) for b in raw]
    pairs = Counter(zip(kinds, kinds[1:], strict=False))
    out = np.zeros(ranking.WIDTH)
    for (a, b), n in pairs.items():
        out[a * 40 + b] = math.sqrt(n / len(raw))
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw.lower()) if w]
    out[1600:] = [math.log1p(len(raw)), math.log1p(kinds.count(39)), len(set(words)) / max(1, len(words)), len(raw) / max(1, len(words)), math.log1p(len(words))]
    return out


def test_features_and_scores_equal_a_plain_recomputation(spark):
    rng = np.random.default_rng(5)
    texts = ["", "One word", "Ünïcode ß 契約\n\n 12.5% of \t\x0b it!", "a\nb " * 9, "long words here, " * 70_000 + "\nend"]
    texts += ["".join(chr(c) for c in rng.integers(32, 400, 60)) for _ in range(20)]
    got = ranking.features_of(pa.array(texts))
    for t, f in zip(texts, got, strict=True):
        assert f == pytest.approx(plain_features(t), rel=1e-4, abs=1e-6)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    ranker = ranking.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in ranking.score(docs, ranker).collect()}
    kept = {r.doc_id for r in ranking.good(docs, ranker).collect()}
    for r in docs.limit(120).collect():
        s = float(((plain_features(r.text) - ranker.mean) / ranker.scale) @ ranker.weights)
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, (s - ranker.threshold) / ranker.spread))))
        assert scores[r.doc_id] == pytest.approx(want, abs=2e-3)
    assert kept == {k for k, s in scores.items() if s >= 0.5}


def test_the_fit_lowers_the_pairwise_loss_and_the_threshold_is_the_best_quantile():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, ranking.WIDTH)).astype(np.float32)
    label = (x[:, 0] + 0.5 * rng.normal(size=300) > 0).astype(int)
    ranker = ranking.learn(x.copy(), label)
    s = (x - ranker.mean) / ranker.scale @ ranker.weights
    good, bad = s[label == 1], s[label == 0]
    loss = np.log1p(np.exp(-(good[:, None] - bad[None, :]))).mean()  # over all pairs, where the fit saw some of them
    assert loss < 0.2 * math.log(2)
    right = lambda t: (good >= t).mean() + (bad < t).mean()
    assert right(ranker.threshold) >= max(right((a + b) / 2) for a, b in itertools.pairwise(np.unique(np.quantile(s, np.linspace(0, 1, 401))))) - 1e-6
