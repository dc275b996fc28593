"""Repair of conversations: the cheapest edits that make the roles alternate, by integer shortest paths.

The rows of a conversation, in order of turn (nulls first; ties by role and text), have *faults*: blank (no character other
than space, tab to CR), duplicate (role and text seen earlier), truncated (the last such character is none of ``.!?``); a row's first
fault counts. Each row is kept (K, cost 0), given the role user or assistant (R, 3) or deleted (D, 4; blank and duplicate
ones must be); a row without text may be inserted anywhere (I, 3, user or assistant). A truncated row that stays adds 3. The initials of the
roles must give ``(s?(ua)+)?``. Of the cheapest edits those whose letters come first in ASCII order are taken.

The graph has a node for each row and state of that pattern; an edit is an edge. A path's weight is one integer:
the high digits are its cost, below them stand the letters of its edits, three bits each, first letter highest, in a field of
fixed width that zeros fill up to its end. The letters' codes have their ASCII order, so the least integer is the cheapest path and
among those the first in letters; the search takes the minimum of integers from the last row back, and the letters are
read off the result, without pointers. At most one insertion stands before a row: two lead to a state whose continuations can be
had for less.

Long conversations: rows are dealt by ranges of (conv_id, turn, role, text) and cut into *chunks* of at most ``CHUNK`` rows, so that
integers stay short and a long conversation is many tasks' work. A chunk gives the least weight from each state to each state. Its
letters end with that of its last row, so of two paths that leave a state none is the beginning of the other, and which is
first is settled within the chunk: between chunks only costs and ranks are needed, a few numbers for each. They are chained in two
streamed passes over chunks, one back, one forth. Only the digest of a whole conversation is streamed row by row in one task,
in constant memory.

Null roles and texts count as one space. A role whose first letter is none of s, u, a, or that is empty, cannot be kept. Rows whose
conv_id is null are one conversation. Repeated rows are duplicates. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import keep, small_batches

CHUNK = 1024
RETYPE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
BEGIN, SYSTEM, USER, ASSISTANT = range(4)  # what the roles so far end with
STATES = range(4)
FOLLOWING = {BEGIN: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by an inserted or retyped row
LETTERS = " DIKR"  # codes 1 to 4, in ASCII order
ENDINGS = {BEGIN: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept row."""
    if initial == "s":
        return SYSTEM if state == BEGIN else None
    return FOLLOWING[state] if initial and initial == {USER: "u", ASSISTANT: "a"}[FOLLOWING[state]] else None


def chunk_paths(rows: list[tuple[str, int]]) -> list[tuple[int, str] | None]:
    """For rows (role's initial, fault): (cost, letters) of the best path from state p to state q at 4p + q."""
    bits = 3 * 2 * len(rows)
    letters = (1 << bits) - 1
    out: list[tuple[int, str] | None] = [None] * 16
    first = {c: k << bits >> 3 for k, c in enumerate(LETTERS)}

    def ahead(letter: str, cost: int, weight: int | None) -> int | None:
        """The weight of a path with one more edge before it."""
        if weight is None:
            return None
        return (weight >> bits) + cost << bits | first[letter] | (weight & letters) >> 3

    def least(weights: list[int | None]) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    for target in STATES:
        best: list[int | None] = [0 if s == target else None for s in STATES]
        for initial, fault in reversed(rows):
            more = UNFINISHED if fault == TRUNCATED else 0
            now = []
            for s in STATES:
                ways = [ahead("D", DELETE, best[s])]
                if fault not in (BLANK, DUPLICATE):
                    ways.append(ahead("R", RETYPE + more, best[FOLLOWING[s]]))
                    to = kept_state(s, initial)
                    if to is not None:
                        ways.append(ahead("K", more, best[to]))
                now.append(least(ways))
            best = [least([now[s], ahead("I", INSERT, now[FOLLOWING[s]])]) for s in STATES]
        for s in STATES:
            if best[s] is not None:
                digits, text = best[s] & letters, []
                for shift in range(bits - 3, -1, -3):
                    code = digits >> shift & 7
                    if not code:
                        break
                    text.append(LETTERS[code])
                out[4 * s + target] = (best[s] >> bits, "".join(text))
    return out


def _rows_of(arrow: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in arrow:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    for some in itertools.batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _mapped(df: DataFrame, make, columns: list[tuple[str, str, pa.DataType | None]], key: str) -> DataFrame:
    """mapInArrow with a generator over rows; a column without Arrow type has that of the first input column."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(arrow, None)
        if head is not None:
            own = head.schema.field(0).type
            schema = pa.schema([(name, kind or own) for name, _, kind in columns])
            yield from _batches(make(_rows_of(itertools.chain([head], arrow))), schema)

    return df.mapInArrow(run, ", ".join(f"{name} {sql or key}" for name, sql, _ in columns))


def ordered(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows with their place, chunk, fault (but duplicates) and initial, written in ranges of conversation and turn."""
    salt = F.monotonically_increasing_id()  # equal rows need not meet
    filled = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), salt.alias("salt")
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    placed = filled.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    written = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(written == "", BLANK).when(F.right(written, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    return placed.select(
        "conv_id", "turn", "role", "text", "place", F.floor(F.col("place") / chunk).alias("chunk"), fault.alias("fault"),
        F.substring("role", 1, 1).alias("initial"),
    )


def chunk_table(placed: DataFrame) -> DataFrame:
    """(conv_id, first, counts of faults and illegal pairs, initials at both ends, costs, ranks, audits) of each chunk."""
    key = placed.schema["conv_id"].dataType.simpleString()
    first = placed.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    narrow = placed.select("conv_id", "chunk", "place", "initial", "fault").join(first, "place", "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("new").isNull(), DUPLICATE).otherwise(F.col("fault"))
    dealt = narrow.select("conv_id", "chunk", "place", "initial", fault.alias("fault"))
    dealt = dealt.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "place")

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (conv, _), run in itertools.groupby(rows, key=lambda r: r[:2]):
            run = list(run)
            initials, faults = [r[3] for r in run], [r[4] for r in run]
            paths = chunk_paths(list(zip(initials, faults, strict=True)))
            ranks = [0] * 16
            for s in STATES:
                for rank, q in enumerate(sorted((q for q in STATES if paths[4 * s + q]), key=lambda q: paths[4 * s + q][1])):
                    ranks[4 * s + q] = rank
            yield (
                conv, run[0][2], faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
                sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), initials[0], initials[-1],
                [p[0] if p else -1 for p in paths], ranks, [p[1] if p else None for p in paths],
            )

    columns = [("conv_id", None, None), ("first", "bigint", pa.int64()), *[(c, "bigint", pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")],
               ("head", "string", pa.string()), ("tail", "string", pa.string()), ("costs", "array<bigint>", pa.list_(pa.int64())),
               ("ranks", "array<int>", pa.list_(pa.int32())), ("audits", "array<string>", pa.list_(pa.string()))]
    return _mapped(dealt, make, columns, key)


def chosen_paths(chunks: DataFrame) -> DataFrame:
    """(conv_id, first, pick, border, ending): which path of each chunk is taken, illegal pairs with the chunk before, letters after the last."""
    key = chunks.schema["conv_id"].dataType.simpleString()

    def back(rows: Iterator[tuple]) -> Iterator[tuple]:
        """The best state after each chunk by the state before it; chunks come last first."""
        for conv, run in itertools.groupby(rows, key=lambda r: r[0]):
            rest, last = {s: INSERT * len(e) for s, e in ENDINGS.items()}, True
            for _, first, costs, ranks, head, tail in run:
                to = []
                for s in STATES:
                    ways = [(costs[4 * s + q] + rest[q], ranks[4 * s + q], q) for q in STATES if costs[4 * s + q] >= 0 and q in rest]
                    to.append(min(ways) if ways else None)
                rest = {s: way[0] for s, way in zip(STATES, to, strict=True) if way}
                yield conv, first, [way[2] if way else -1 for way in to], head, tail, last
                last = False

    def forth(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, run in itertools.groupby(rows, key=lambda r: r[0]):
            state, before = BEGIN, None
            for _, first, to, head, tail, last in run:
                following = to[state]
                yield conv, first, 4 * state + following, int(before is not None and before + head not in ("su", "ua", "au")), ENDINGS[following] if last else ""
                state, before = following, tail

    narrow = chunks.select("conv_id", "first", "costs", "ranks", "head", "tail").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("first"))
    states = _mapped(narrow, back, [
        ("conv_id", None, None), ("first", "bigint", pa.int64()), ("to", "array<int>", pa.list_(pa.int32())),
        ("head", "string", pa.string()), ("tail", "string", pa.string()), ("last", "boolean", pa.bool_()),
    ], key)
    states = states.repartition("conv_id").sortWithinPartitions("conv_id", "first")
    return _mapped(states, forth, [
        ("conv_id", None, None), ("first", "bigint", pa.int64()), ("pick", "int", pa.int32()), ("border", "bigint", pa.int64()), ("ending", "string", pa.string()),
    ], key)


class Plan:
    """The rows in order, and for each chunk of them its edits and counts."""

    def __init__(self, rows: DataFrame, chunk: int = CHUNK):
        small_batches(rows.sparkSession)
        self.rows = keep(ordered(rows, chunk), "repair-rows")
        chunks = keep(chunk_table(self.rows), "repair-chunks")
        picked = chosen_paths(chunks).drop("conv_id")
        at = F.col("pick") + 1
        self.chunks = keep(chunks.join(picked, "first").select(
            "conv_id", "first", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("border")).alias("illegal"),
            (F.element_at("costs", at) + INSERT * F.length("ending")).alias("cost"),
            F.concat(F.element_at("audits", at), "ending").alias("audit"),
        ), "repair-plan")


def edited(plan: Plan) -> DataFrame:
    """Every row with its edit: (conv_id, turn, edit, role, text); inserted rows have no turn, deleted ones stay as they were.

    The rows of a conversation follow each other, in order, within one partition.
    """
    rows = plan.rows.select("conv_id", "place", F.lit(1).alias("kind"), "turn", "role", "text")
    audits = plan.chunks.select("conv_id", F.col("first").alias("place"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    dealt = audits.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind")
    names = {USER: "user", ASSISTANT: "assistant"}

    def make(stream: Iterator[tuple]) -> Iterator[tuple]:
        state, audit, at, owner = BEGIN, "", 0, None

        def inserted() -> Iterator[tuple]:
            nonlocal state, at
            while at < len(audit) and audit[at] == "I":
                state, at = FOLLOWING[state], at + 1
                yield owner, None, "I", names[state], ""

        for conv, _, kind, turn, role, text in stream:
            if kind == 0:  # a chunk's letters; what is left of the last ones are insertions at the end
                yield from inserted()
                if conv != owner or not audit:
                    state = BEGIN
                audit, at, owner = text, 0, conv
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = kept_state(state, role[:1])
            elif edit == "R":
                state = FOLLOWING[state]
                role = names[state]
            yield conv, turn, edit, role, text
        yield from inserted()

    columns = [("conv_id", None, None), ("turn", "bigint", pa.int64()), ("edit", "string", pa.string()), ("role", "string", pa.string()), ("text", "string", pa.string())]
    return _mapped(dealt, make, columns, plan.rows.schema["conv_id"].dataType.simpleString())


def repaired(plan: Plan) -> DataFrame:
    """The rows that the repaired conversations consist of."""
    return edited(plan).where("edit <> 'D'")


def report(rows: DataFrame, plan: Plan, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: faults, cost and letters of the edits, digest of the repaired rows."""
    key = rows.schema["conv_id"].dataType.simpleString()

    def digest(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, run in itertools.groupby(stream, key=lambda r: r[0]):
            sha, letters, empty = hashlib.sha256(), [], True
            for _, _, edit, role, text in run:
                letters.append(edit)
                if edit != "D":
                    sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            yield conv, "".join(letters), sha.hexdigest()

    digests = _mapped(edited(plan), digest, [("id", None, None), ("audit", "string", pa.string()), ("repaired_sha256", "string", pa.string())], key)
    turns = plan.rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps")
    ).withColumnRenamed("conv_id", "of_turns")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    sums = plan.chunks.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts]).withColumnRenamed("conv_id", "of_sums")
    out = conversations.select("conv_id").distinct()
    for part, name in ((digests, "id"), (turns, "of_turns"), (sums, "of_sums")):
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col(name)), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *counts)]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))
