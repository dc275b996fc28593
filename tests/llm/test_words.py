import tracemalloc

import numpy as np
import pyarrow as pa

from gramlode.llm import words as w


def hashes(texts):
    """Word hashes of each text."""
    data, offsets = w.text_bytes(pa.array(texts))
    out = [[] for _ in texts]
    for run in w.words(data, offsets):
        for d, h in zip(run.doc.tolist(), run.hash.tolist(), strict=True):
            out[run.first + d].append(h)
    return out


def test_long_texts_are_cut_between_words():
    words = [f"w{i % 997}" for i in range(300_000)]
    one = dict(zip([f"W{i}" for i in range(997)], [h for h, in hashes([f"w{i}" for i in range(997)])], strict=True))
    got = hashes(["a b", " ".join(words).upper(), None, "x" * (3 << 20) + " w5", "", "\n\t"])
    assert got[1] == [one[x.upper()] for x in words]
    assert len(got[3]) == 2 and got[3][1] == one["W5"]
    assert [len(g) for g in got] == [2, 300_000, 0, 2, 0, 0]
    assert all(len(p) <= 2 * w.SLICE_BYTES for p in w._powers.values())


def test_memory_follows_the_words_of_a_long_text():
    text = np.frombuffer(b"some words of ten  " * 1_100_000, np.uint8)
    tracemalloc.start()
    (run,) = w.words(text, np.array([0, len(text)]))
    assert len(run.hash) == 4_400_000
    assert tracemalloc.get_traced_memory()[1] < 7 * len(text)
    tracemalloc.stop()
