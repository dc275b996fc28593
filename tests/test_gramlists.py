"""Grams and posting lists of Arrow batches: equal to plain windows, and a row for a gram, not for each of its documents."""

import random

import pyarrow as pa
import pytest

from gramlode import TableCorpus, build_index, fresh_folder
from gramlode.operators import gramlists

LETTERS = "abAB Kſé契\n\x00😀\r"


def brute(text):
    folded = "".join({"K": "k", "ſ": "s"}.get(c, c.lower() if "A" <= c <= "Z" else c) for c in text)
    return {folded[i : i + n] for n in (2, 3) for i in range(len(folded) - n + 1)}


@pytest.mark.parametrize("chars", [10**6, 5, 1])
@pytest.mark.parametrize("flags", [10**6, 3])
def test_grams_equal_windows(monkeypatch, chars, flags):
    monkeypatch.setattr(gramlists, "SLICE_CHARS", chars)
    monkeypatch.setattr(gramlists, "FLAGS_HELD", flags)
    r = random.Random(1)
    for _ in range(40):
        texts = [None if r.random() < 0.1 else "".join(r.choice(LETTERS) for _ in range(r.randrange(14))) for _ in range(r.randrange(1, 9))]
        got = gramlists.gram_arrays(texts).to_pylist()
        assert [g and sorted(g) for g in got] == [None if t is None else sorted(brute(t)) for t in texts]


def batch(docs, grams):
    return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(grams, pa.list_(pa.string()))], ["doc", "grams"])


@pytest.mark.parametrize("held", [10**6, 3])
@pytest.mark.parametrize("bits", [2, 16])
def test_lists_hold_every_pair_once(monkeypatch, held, bits):
    monkeypatch.setattr(gramlists, "PAIRS_HELD", held)
    docs, grams = [5, 6, 7, 70000, 70001, (3 << 33) + 9], [["a", "b"], ["b"], None, ["a"], [], ["b", "c"]]
    made = list(gramlists.posting_lists(bits)(iter([batch(docs[:3], grams[:3]), batch([], []), batch(docs[3:], grams[3:])])))
    got = sorted((r["gram"], (r["block"] << bits) | (d & 0xFFFF)) for b in made for r in b.to_pylist() for d in r["docs"])
    assert got == sorted((g, d) for d, gs in zip(docs, grams) for g in gs or ())


def test_rows_follow_the_grams_not_the_documents():
    docs = 3000
    made = list(gramlists.posting_lists(16)(iter([batch(list(range(docs)), [["ab", "bc", "abc"]] * docs)])))
    assert sum(b.num_rows for b in made) == 3


def test_low_numbers_of_a_block_keep_their_sign(spark, monkeypatch):
    """Documents beyond the 32,768th of a block come back with their own numbers, in order."""
    df = spark.range(40_000).selectExpr("id AS path", "'abc' AS text").coalesce(1)
    monkeypatch.setattr("gramlode.operators.index.spread", lambda texts: texts)
    index = build_index(TableCorpus(df).texts(), fresh_folder(spark, "low"))
    for row in index.postings(["abc"]).collect():
        assert row.docs == sorted(row.docs)
    assert sorted(r.doc for r in index.pairs(["abc"]).collect()) == sorted(r.doc for r in index.docs().collect())
