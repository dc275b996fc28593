import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from gramlode.llm import packing
from gramlode.llm.common import rank_encoding, vocabulary

WORDS = "alpha beta gamma delta river stone bread window lantern orchard copper violin 42 é ß — '".split()


def docs(spark, n=120):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 900))), "x") for k in range(n)]
    rows += [(n, None, None), (n + 1, "", "x"), (None, "one two", "x"), (n + 2, "<|endoftext|> x", "x"), (0, rows[0][1], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string"), rows


def check(got, rows, window, padding):
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = defaultdict(list)
    for k, t, _ in rows:
        want[k].append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for k, ids in want.items():
        copies = len(ids)
        assert sum(r.length for r in by_doc[k]) == sum(map(len, ids))
        cover = np.zeros(len(ids[0]), int)
        for r in by_doc[k]:
            assert r.doc_tokens == len(ids[0])
            assert r.ids_crc32 == zlib.crc32(ids[0][r.start : r.start + r.length].tobytes())
            cover[r.start : r.start + r.length] += 1
        assert (cover == copies).all()
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert sum(sum(r.length for r in p) < window for p in by_seq.values()) <= padding


def test_every_id_once_and_little_padding(spark):
    df, rows = docs(spark)
    df = df.coalesce(2)
    check(packing.digests(packing.pack(df)).collect(), rows, 1024, 2)
    check(packing.digests(packing.pack(df, window=16, shard=10)).collect(), rows, 16, 30)


def test_neighbours_are_the_best_by_brute_force():
    rng = np.random.default_rng(1)
    tails = [rng.zipf(1.3, rng.integers(1, 60)).clip(0, 500) for _ in range(80)]
    index = packing.Bm25(tails)
    n, avg = len(tails), np.mean([len(t) for t in tails])
    df = {t: sum(t in set(d) for d in tails) for d in tails for t in d}
    idf = {t: np.log1p((n - f + 0.5) / (f + 0.5)) for t, f in df.items()}

    def weight(t, d):
        tf = (d == t).sum()
        return max(1, round(256 * (idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))))) if tf else 0

    unused = rng.random(n) < 0.7
    for seed in range(n):
        query = sorted(set(tails[seed]))
        scores = {k: sum(weight(t, tails[k]) for t in query) for k in range(n) if unused[k]}
        want = sorted((k for k, s in scores.items() if s > 0), key=lambda k: (-round(scores[k], 9), k))[: packing.NEIGHBOURS]
        got = index.neighbours(seed, unused)
        assert [round(scores[k], 6) for k in got] == [round(scores[k], 6) for k in want]


def test_all_terms_of_a_seed_count():
    # the seed shares its 40 middling terms with one tail; its heaviest terms are its own
    own = np.repeat(np.arange(1000, 1020), 3)
    shared = np.arange(2000, 2040)
    tails = [np.concatenate([own, shared]), shared.copy(), *[np.arange(k * 50, k * 50 + 30) for k in range(60, 90)]]
    index = packing.Bm25(tails)
    unused = np.ones(len(tails), bool)
    unused[0] = False
    assert index.neighbours(0, unused).tolist() == [1]

    rng = np.random.default_rng(2)
    tails = [rng.zipf(1.2, rng.integers(1, 300)).clip(0, 2000) for _ in range(150)]
    n, avg, sets = len(tails), np.mean([len(t) for t in tails]), [set(t.tolist()) for t in tails]
    index, unused = packing.Bm25(tails), rng.random(n) < 0.7

    def score(seed, k):
        total = 0.0
        for t in sets[seed] & sets[k]:
            tf, f = int((tails[k] == t).sum()), sum(t in s for s in sets)
            total += max(1, round(256 * np.log1p((n - f + 0.5) / (f + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tails[k]) / avg))))
        return total

    for seed in range(0, n, 10):
        scores = {k: score(seed, k) for k in range(n) if unused[k]}
        want = sorted((s for s in scores.values() if s > 0), reverse=True)[: packing.NEIGHBOURS]
        assert np.allclose([scores[k] for k in index.neighbours(seed, unused)], want)


def test_alike_texts_share_a_window(spark):
    topics = ["violin orchestra symphony", "glacier moraine crevasse", "risotto saffron parmesan"]
    rows = [(k, " ".join([topics[k % 3]] * 30)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    seqs = defaultdict(set)
    for r in packing.pack(df).collect():
        seqs[r.sequence_id].add(r.doc_id % 3)
    assert sum(len(s) == 1 for s in seqs.values()) >= len(seqs) - 2


def test_alike_texts_meet_across_splits_and_shards(spark):
    # each topic has two texts, in different splits and farther apart than a shard
    rng = random.Random(5)
    filler = [rng.choice(WORDS) for _ in range(200)]
    topics = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(6)) for _ in range(40)]
    rows = [(k, " ".join([topics[k % 40]] * 40 + rng.sample(filler, 20))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(8, "doc_id")
    seqs = defaultdict(set)
    for r in packing.pack(df, window=600, shard=20).collect():
        seqs[r.sequence_id].add(r.doc_id)
    together = {k % 40 for s in seqs.values() for k in s if (k + 40) % 80 in s}
    assert len(together) >= 20


def test_statistics_are_those_of_all_tails(spark):
    tails = [np.array(t, "<u4") for t in ([1, 1, 2], [2, 3], [3, 3, 3, 3], [2])]
    df = spark.createDataFrame([(t.tobytes(),) for t in tails], "ids binary").repartition(3)
    corpus = packing.statistics(df)
    assert (corpus.n, corpus.mean, corpus.df.tolist()) == (4, 2.5, [0, 1, 3, 2])
    assert corpus.keys(tails, 2).tolist() == [[2, 2], [3, 2], [3, 3], [2, 2]]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_of_a_batch_are_encoded_once(monkeypatch):
    path = vocabulary(packing.RANKS)
    real, seen = rank_encoding(path), []

    class Counting:
        def encode_to_numpy(self, text, **options):
            seen.append(len(text))
            return real.encode_to_numpy(text, **options)

    monkeypatch.setattr(packing, "rank_encoding", lambda path: Counting())
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tok.encode_special_tokens = True

    def encoded(texts):
        ids, bounds = packing.encode(pa.array(texts, pa.string()), path)
        assert ids.dtype == np.dtype("<u4") and len(bounds) == len(texts) + 1
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 0], t

    rng = random.Random(4)
    parts = ["a", "we'll", "'s", " ", " ", " ", "  ", "\n", " \n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\u2003", "\u3000", "é", "日本", "42", "!?", "<|endoftext|>", "\u0301", "👍", "\x00"]
    encoded([])
    encoded([None, "", " ", "  ", "a ", " a", "a  b", "a\n b", "a\n", "\n"])
    for _ in range(30):
        encoded(["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 60))])
    monkeypatch.setattr(packing, "LONG_TEXT", 40)
    encoded(["river stone " * n for n in range(8)])
    monkeypatch.undo()
    monkeypatch.setattr(packing, "rank_encoding", lambda path: Counting())
    seen.clear()
    texts = [" ".join(rng.choice(WORDS) for _ in range(500)) for _ in range(50)]
    encoded(texts)
    assert sum(seen) < sum(map(len, texts)) / 20
