import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from gramlode.llm import repair

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(BLANKS)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, letters, repaired rows) by dynamic programming over whole strings of letters, forward, all paths of least cost kept."""
    states = {"": (0, [("", ())])}  # initials so far, as their last letter; with all cheapest (letters, rows)

    def insertions(states):
        todo = dict(states)
        for _ in range(2):
            more = {}
            for last, (cost, paths) in todo.items():
                role = "assistant" if last == "u" else "user"
                offer(more, role[0], cost + 3, [(a + "I", r + ((role, ""),)) for a, r in paths])
            for last, (cost, paths) in more.items():
                offer(states, last, cost, paths)
            todo = more
        return states

    def offer(states, last, cost, paths):
        if last not in states or cost < states[last][0]:
            states[last] = (cost, list(paths))
        elif cost == states[last][0]:
            states[last][1].extend(p for p in paths if p not in states[last][1])

    for (role, text), fault in zip(rows, faults(rows), strict=True):
        following = {}
        for last, (cost, paths) in insertions(states).items():
            offer(following, last, cost + 4, [(a + "D", r) for a, r in paths])
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            for new, edit, price in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                first = new[:1]
                if first == "s" and last == "" or first == "u" and last in ("", "s", "a") or first == "a" and last == "u":
                    if first == "s" and edit == "R":
                        continue
                    offer(following, first, cost + price + more, [(a + edit, r + ((new, text),)) for a, r in paths])
        states = following
    ends = [(cost, a, r) for last, (cost, paths) in insertions(states).items() if last in ("", "a") for a, r in paths]
    return min(ends, key=lambda e: (e[0], e[1]))


def every_way(rows):
    """The same by trying all edits, with up to two insertions at each place."""
    best = None
    inserts = [()] + [(x,) for x in "ua"] + list(itertools.product("ua", repeat=2))
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product("DKua", repeat=len(rows)):
            cost, audit, roles = 0, "", ""
            for k, (role, _) in enumerate(rows):
                audit += "I" * len(gaps[k])
                roles += "".join(gaps[k])
                cost += 3 * len(gaps[k])
                if edits[k] == "D":
                    cost, audit = cost + 4, audit + "D"
                    continue
                if FAULTS[k] in ("blank", "duplicate"):
                    break
                cost += (3 if FAULTS[k] == "truncated" else 0) + (edits[k] != "K") * 3
                audit += "K" if edits[k] == "K" else "R"
                roles += role[:1] or "?" if edits[k] == "K" else edits[k]
            else:
                audit, roles, cost = audit + "I" * len(gaps[-1]), roles + "".join(gaps[-1]), cost + 3 * len(gaps[-1])
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def random_rows(r, n):
    texts = ["Yes.", "No!", "why", "  ", "", "ok?", "same.", "cut off", "end. \n"]
    return [(r.choice(["user", "assistant", "user", "assistant", "system", "tool", "admin", "unit", ""]), r.choice(texts)) for _ in range(n)]


def test_paths_equal_all_ways():
    global FAULTS
    r = random.Random(5)
    for k in range(40):
        rows = random_rows(r, k % 4)
        FAULTS = faults(rows)
        assert cheapest(rows)[:2] == every_way(rows)


def wanted(rows):
    """The report's columns after conv_id and gaps."""
    kinds = faults(rows)
    cost, audit, out = cheapest(rows)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
    return (kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest)


def gaps(turns):
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("chunk", [repair.CHUNK, 3, 1])
def test_report_equals_brute_force(spark, chunk):
    r = random.Random(11)
    turns = []
    for conv in [None, *range(70)]:
        n = r.choice([1, 2, 3, 5, 9, 30])
        for k, (role, text) in enumerate(random_rows(r, n)):
            turns.append((conv, r.choice([k, 2 * k, None]) if r.random() < 0.2 else 2 * k, role, text, "x"))
    for k in range(60):
        turns.append((99, 5, "user", "again.", "x"))  # a conversation of one row, repeated
    for k, (role, text) in enumerate(random_rows(r, 150)):
        turns.append((98, k, role, text, "x"))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, cost string")
    plan = repair.Plan(df, chunk)
    everyone = df.select("conv_id").union(spark.createDataFrame([(1000,)], "conv_id long"))
    got = {x.conv_id: tuple(x[c] for c in COLUMNS[1:]) for x in repair.report(df, plan, everyone).collect()}
    by_conv = {}
    for conv, turn, role, text, _ in turns:
        by_conv.setdefault(conv, []).append((turn, role, text))
    want = {1000: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    for conv, rows in by_conv.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        want[conv] = (gaps([t for t, _, _ in rows]), *wanted([x[1:] for x in rows]))
    assert got == want
    kept = repair.repaired(plan).collect()
    assert sum(x.edit == "I" for x in kept) == sum(w[6].count("I") for w in want.values()) and all(x.edit != "D" for x in kept)


def test_no_rows_and_long_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(empty, repair.Plan(empty), empty).collect() == []
    n = 21000
    df = spark.range(n).selectExpr("7 AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "concat('t', id, '.') AS text")
    (row,) = repair.report(df, repair.Plan(df), df).collect()
    # u a a repeated: each second answer is retyped or gets a question
    assert row.cost == wanted([("user" if k % 3 == 0 else "assistant", f"t{k}.") for k in range(300)])[4] * n // 300
    assert len(row.audit) >= n and row.gaps == 0


def test_query_equals_brute_force(spark):
    got = {tuple(r[c] for c in COLUMNS) for r in entry.queries()["op12_big_integer_repair"](spark, SF).collect()}
    by_conv, want = {}, set()
    for conv, turn, role, text in duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall():
        rows = by_conv.setdefault(conv, [])
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, rows in by_conv.items():
        rows.sort()
        want.add((conv, gaps([t for t, _, _ in rows]), *wanted([x[1:] for x in rows])))
    assert got == want and len(want) == len(by_conv)
