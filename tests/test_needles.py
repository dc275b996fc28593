"""Many substrings in one pass: equal to a search of each, whatever the blocks, the folding and the caps."""

import random

import pytest

from gramlode import TableCorpus, build_index, fresh_folder, search, search_batch
from gramlode.plans import batch, needles


def brute(texts, asked, per_file):
    """(path, query, line, text) by looking at every line for every needle."""
    out = []
    for path, text in texts:
        for query, needle, case in asked:
            found = 0
            for k, line in enumerate((text or "").split("\n")):
                if needle in (line if case else needles.lowered(line)) and (per_file is None or found < per_file):
                    found += 1
                    out.append((path, query, k + 1, line.rstrip()))
    return sorted(out)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["ab", "abc", "ABC", "bca", "cab", "É", "éa", "K", "x y", "契約", "\r", " ", ""]
    return [(f"p{k:03d}", r.choice([None, "", "\n"]) if r.random() < 0.1 else "\n".join("".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 8)))) for k in range(n)]


@pytest.mark.parametrize("per_file", [None, 2])
def test_hits_equal_every_needle_alone(spark, monkeypatch, per_file):
    texts = corpus(3)
    asked = [(1, "ab", False), (2, "ab", True), (3, "abc", False), (4, "ABC", True), (5, "é", False), (6, "É", True), (7, "契約a", False), (8, "bc", False),
             (9, "ab", False), (10, "k", False), (11, "zz", False), (12, " ", True)]
    df = spark.createDataFrame(texts, "path string, text string").repartition(3)
    for block in (needles.BLOCK_BYTES, 40):
        monkeypatch.setattr(needles, "BATCH_HITS", 3)
        blocks = needles.blocks_of(asked, block)
        monkeypatch.setattr(needles, "blocks_of", lambda items, blocks=blocks: blocks)
        got = sorted(map(tuple, needles.needle_hits(df, asked, per_file, "path").collect()))
        assert got == brute(texts, asked, per_file) and len(got) > 100
        monkeypatch.undo()


def test_blocks_hold_every_needle():
    asked = [(k, "x" * (k % 50), k % 2 == 0) for k in range(500)]
    blocks = needles.blocks_of(iter(asked), 300)
    assert [n for b in blocks for n in b] == asked and len(blocks) > 10 and needles.blocks_of([]) == []


def test_batch_by_automaton_equals_batch_by_pairs(spark, monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("abcde") for _ in range(4)) for _ in range(300)]
    texts = [(f"p{k:04}", "\n".join(" ".join(r.choice(words) for _ in range(6)) for _ in range(5))) for k in range(300)]
    df = spark.createDataFrame(texts, "path string, text string")
    index = build_index(TableCorpus(df).texts(), fresh_folder(spark, "t"))
    asked = [(k, w.upper() if k % 3 else w[:2], False, k % 5 == 0, 3 if k == 7 else None) for k, w in enumerate(words[:80])]
    asked += [(100, "[a-c]{2}" + words[0], True, False, None), (101, words[1] + "\n" + words[2], False, False, None), (102, "d[ab]e|" + words[3], True, False, None)]
    table = spark.createDataFrame(asked, "query_id long, query string, regex boolean, case_sensitive boolean, max int")
    for most in (None, 4):
        rows = []
        for together in (1, 10**9):
            monkeypatch.setattr(batch, "NEEDLES_TOGETHER", together)
            rows.append(sorted(map(tuple, search_batch(index, table, max_results=most).collect())))
        assert rows[0] == rows[1] and len({x[0] for x in rows[0]}) > 50
    one = [(h.file, h.line, h.text) for h in search(index, words[4].upper(), max_results=None).hits.collect()]
    monkeypatch.setattr(batch, "NEEDLES_TOGETHER", 1)
    assert sorted(one) == sorted((x.file, x.line, x.text) for x in search_batch(index, table, max_results=None).where("query_id = 4").collect())


def test_work_follows_the_text_not_the_needles():
    """A thousand times the needles does not make a pass a hundred times longer."""
    import time

    r = random.Random(1)
    text = "\n".join("".join(r.choice("abcdefghij ") for _ in range(80)) for _ in range(3000))
    breaks = [k for k, c in enumerate(text) if c == "\n"]
    seconds = []
    for n in (10, 10_000):
        automaton = needles.automaton_of([(k, "".join(r.choice("abcdefghijkl") for _ in range(9))) for k in range(n)])
        begin = time.process_time()
        for _ in range(5):
            sum(1 for _ in needles.lines_with(automaton, text, breaks, None))
        seconds.append(time.process_time() - begin)
    assert seconds[1] < 30 * max(seconds[0], 0.01)
