import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gramlode.llm import bagminhash as bmh
from gramlode.llm import groups
from gramlode.llm.groups import classes
from gramlode.llm.words import shingles, text_bytes, words


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    return (a & b).total() / max(1, (a | b).total())


def brute(rows):
    """class (least doc_id) of each row by comparing all."""
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (not bags[i] and not bags[j]) or (bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8):
                parent[find(i)] = find(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            ids[find(i)] = min(ids.get(find(i), k), k)
    return sorted(((k, ids.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def corpus(n_groups=12, size=8, n=150):
    rng = random.Random(2)
    vocab = ["w%d" % k for k in range(3000)]
    rows, k = [], 0
    for g in range(n_groups):
        base = [rng.choice(vocab) for _ in range(n)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(n)] = rng.choice(vocab)
            rows.append((k, " ".join(t)))
            k += 1
    rows += [(k + i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 80)))) for i in range(60)]
    rows += [(5000, None), (5001, ""), (5002, "   \n"), (5003, "one"), (5004, "One"), (None, rows[3][1]), (0, rows[0][1]),
             (5005, "tail alone here"), (None, "only without id"), (5006, "echo " * 20000), (5007, "echo " * 19990)]
    return rows


@pytest.mark.parametrize("options", [{}, {"small_bucket": 2, "block": 3}])
def test_classes_equal_brute_force(spark, options):
    rows = corpus(8 if options else 12)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = bmh.near_classes(docs, **options)
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=str) == brute(rows)


def test_one_document_of_each_class_stays(spark):
    rows = corpus(4)
    rows += [rows[7], (7, "another text under the same number here")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    left = bmh.deduplicated(docs)
    assert left.columns == docs.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    bags = [bag(t) for _, t in got]
    assert len(got) == len(got and {(k, t) for k, t in got})
    want = {c if c is not None else k for k, c in brute(rows)}
    assert len([k for k, _ in got if k is not None]) in (len(want - {None}), len(want - {None}) + 1)
    for i in range(len(got)):
        for j in range(i):
            assert not (bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8), (got[i][0], got[j][0])
    assert bmh.deduplicated(docs.where("false")).collect() == []


def test_signatures_are_unbiased_for_weights():
    rng = np.random.default_rng(4)
    for shared, own, heavy in ((60, 20, 1), (20, 20, 9), (5, 30, 40)):
        est, m = [], 144
        h = rng.integers(1, 1 << 62, (150, shared + 2 * own)).astype(np.uint64)
        for row in h:
            ca, cb = rng.integers(1, heavy + 1, shared + own), rng.integers(1, heavy + 1, shared + own)
            ea, eb = row[: shared + own], np.concatenate([row[:shared], row[shared + own :]])
            sig = bmh.signatures(np.repeat([0, 1], shared + own), np.concatenate([ea, eb]), np.concatenate([ca, cb]), 2, m)
            lo = np.minimum(ca[:shared], cb[:shared]).sum()
            true = lo / (ca.sum() + cb.sum() - lo)
            est.append((sig[0] == sig[1]).mean() - true)
        assert abs(np.mean(est)) < 0.012, (shared, own, heavy, np.mean(est))


def test_word_hashes_see_words_only():
    column = pa.array(["The cat  sat", "the CAT\tsat", None, "", "thecat sat", "x", " x ", "é É"])
    by_doc = {}
    for w in words(*text_bytes(column)):
        for d, h in zip(w.doc + w.first, w.hash, strict=True):
            by_doc.setdefault(int(d), []).append(int(h))
    assert by_doc[0] == by_doc[1] and len(by_doc[0]) == 3 and 2 not in by_doc and 3 not in by_doc
    assert by_doc[4][0] not in by_doc[0] and by_doc[4][1] == by_doc[0][2] and by_doc[5] == by_doc[6] and len(set(by_doc[7])) == 2


def test_short_texts_hash_alike_wherever_they_stand():
    got = []
    for column in (["a b", "c d e f g h"], ["c d e f g h", "a b"], ["a b"]):
        (w,) = words(*text_bytes(pa.array(column)))
        doc, h = shingles(w, 5)
        got.append(sorted(int(x) for x in h[doc == column.index("a b")]))
        assert len(got[-1]) == 1
    assert got[0] == got[1] == got[2]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.class_id for r in classes(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_deduplicated_keeps_columns_of_any_name(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame(
        [(1, text, 5, "p", 1), (2, text, 6, "q", 2), (3, "other words in a row that are not the same", 7, "r", 3), (3, "other words in a row that are not the same", 7, "r", 3)],
        "doc_id long, text string, _hash int, `a.b` string, id int",
    )
    got = bmh.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, text, 5, "p", 1), (3, "other words in a row that are not the same", 7, "r", 3)]


def test_few_edges_are_not_shuffled_in_each_round(spark, monkeypatch):
    real, shuffles = groups.keep, []

    def kept(df, label):
        shuffles.append(df._jdf.queryExecution().toString().count("Exchange hashpartitioning"))
        return real(df, label)

    monkeypatch.setattr(groups, "keep", kept)
    edges = spark.range(60).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.range(100, 140).selectExpr("id AS a", "100 AS b"))
    want = {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}}
    assert {r.node: r.class_id for r in classes(edges).collect()} == want
    assert len(shuffles) > 2 and not any(shuffles[1:])
    monkeypatch.setattr(groups, "TASK_EDGES", 0)  # many edges
    assert {r.node: r.class_id for r in classes(edges).collect()} == want
    assert any(shuffles[2:])
    shuffles.clear()
    assert classes(edges.where("false")).collect() == []
    assert len(shuffles) == 1
