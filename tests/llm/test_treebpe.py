import hashlib
import random

import numpy as np

from gramlode.llm import treebpe
from gramlode.llm.common import rank_encoding, vocabulary

ODD = ["", " ", "   ", "a", "it's we're I'll", "x\r\n\t y  z", " 　 a", "é" * 50, "<|endoftext|>", "'", "a'", "'re",
       "1 2  3   4", "!!!???", "a\x1c b", "😀😀 👩‍👩‍👧", "word " * 40, "nospace" * 40, "\n\n\n   \n x"]


def plain(text):
    enc = rank_encoding(vocabulary(treebpe.RANKS))
    ids = enc.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_tree_equals_plain_encoding_at_every_leaf_size():
    enc = rank_encoding(vocabulary(treebpe.RANKS))
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(["a", "'", "s", " ", "\n", "1", "!", "é", "  ", "re", "\t", "word"])
                           for _ in range(rng.randrange(200))) for _ in range(300)]
    for text in texts:
        for leaf in (1, 3, 16, 100):
            got = treebpe.encode_tree(enc, text, leaf=leaf)
            assert got.tolist() == enc.encode_ordinary(text), (text, leaf)
            assert treebpe.decode_tree(enc, got, leaf=max(leaf, 1)) == text.encode()


def test_rows(spark):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, None, "x"), (1, ODD[4], "y"), (1, ODD[4], "y"), (77, "ab c " * 500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    for options in ({}, {"leaf_chars": 16, "part_chars": 50}):
        got = sorted(map(tuple, treebpe.digests(docs, **options).collect()), key=str)
        assert got == sorted([(k, *plain(t)) for k, t, _ in rows], key=str)


def test_empty_table(spark):
    assert treebpe.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
