"""Which queries a text and its lines meet, by sets of grams."""

import random

import pyarrow as pa
import pytest

from gramlode.functions.text import fold_gram_text
from gramlode.plans import meetings


def cut(text):
    text = fold_gram_text(text)
    return sorted({text[i : i + n] for n in (2, 3) for i in range(len(text) - n + 1)})


@pytest.mark.parametrize("held", [10**6, 2])
def test_texts_and_lines_that_hold_a_set(monkeypatch, held):
    monkeypatch.setattr(meetings, "COUNTS_HELD", held)
    r = random.Random(2)
    for _ in range(30):
        texts = ["".join(r.choice("abK\nſ\rC ") for _ in range(r.randrange(25))) for _ in range(8)]
        asked = [(q, [sorted({"".join(r.choice("abksc ") for _ in range(r.choice((2, 3)))) for _ in range(r.randrange(1, 3))}) for _ in range(2)])
                 for q in (5, None, 7)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts), pa.array([cut(t) for t in texts])], ["doc", "text", "grams"])
        got = [(x["doc"], q) for b in meetings.meeting_queries(asked)(iter([batch])) for x in b.to_pylist() for q in x["asked"]]
        has = lambda grams, sets: any(set(s) <= set(grams) for s in sets)
        assert sorted(got, key=str) == sorted(((d, q) for d, t in enumerate(texts) for q, sets in asked if has(cut(t), sets)), key=str)
        lines = [(x["doc"], x["asked"], h["line"], h["text"]) for b in meetings.meeting_lines(asked)(iter([batch])) for x in b.to_pylist() for h in x["lines"]]
        want = [(d, q, k, line.removesuffix("\r")) for d, t in enumerate(texts) for q, sets in asked
                for k, line in enumerate(t.split("\n"), 1) if has(cut(line), sets)]
        assert sorted(lines, key=str) == sorted(want, key=str)
