import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from gramlode.llm import pii, ranking
from gramlode.llm.common import keep, table, vocabulary
from tests.llm.test_bagminhash import bag, similarity

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns, steps = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(keep(stage(spark, steps[-1], SF), name))
    raw, good, unique, masked = ({r.doc_id: r for r in d.collect()} for d in steps[:4])
    assert all(d.columns == columns for d in steps[1:4])
    # quality: what a model with the same labels predicts for each document alone; most of label 1 stays, of label 0 goes
    ranker = ranking.fit(docs, table(spark, SF, "labels"))
    want = {k for k, r in raw.items() if ranker.scores(ranking.features_of(pa.array([r.text])))[0] >= 0.5}
    assert set(good) == want
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert np.mean([k in good for k, q in labels.items() if q == 1]) > 0.97
    assert np.mean([k in good for k, q in labels.items() if q == 0]) < 0.1
    # near-duplicates: classes by comparing all
    bags = {k: bag(r.text) for k, r in good.items()}
    parent = {k: k for k in good}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in good:
        for j in good:
            if j < i and (similarity(bags[i], bags[j]) >= 0.8 or not (bags[i] or bags[j])):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert set(unique) == {find(k) for k in good}
    # personal data: no base span is left, texts without any are as they were
    assert set(masked) == set(unique)
    for k, r in masked.items():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii.candidates(unique[k].text):
            assert r.text == unique[k].text
    # packing: each id once
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(int)
    for r in steps[4].collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id] += r.length
    assert set(pieces) == set(masked) and max(sequences.values()) <= 1024
    for k, own in pieces.items():
        ids, at = np.array([*tok.encode(masked[k].text, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_edges(spark):
    rows = [(1, "Plain words in a row, and then some more of them.", "en", "s", None, "x"), (None, None, None, None, None, None), (2, "", "en", "s", 0, "x"),
            (1, "Plain words in a row, and then some more of them.", "en", "s", 49, "x"), (3, "mail joe@example.com", "en", "s", 20, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for table_ in (docs, docs.where("false")):
        step = table_
        for _, stage in corpus_pipeline.STAGES[:3]:
            step = keep(stage(spark, step, SF), "t")
            assert step.columns == docs.columns
        assert corpus_pipeline.STAGES[3][1](spark, step, SF).count() >= 0
