"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context, and only its reply is under the
loss mask. A turn's formatted *piece* does not depend on what follows, so the context of an example is a prefix of its
conversation's formatted text. ``formatted`` therefore writes each piece once, with where it begins; an example is
the reference (end of context, loss span, end). That keeps the output linear in the input, also for conversations of
many turns; ``texts`` spells examples out. Turns after the last assistant turn, or a conversation without one, make
a last example without loss, so that no turn is missing from the output.

The template puts a pair of marks around each turn's text. Control strings inside a text (marks and backslashes) are
escaped: a backslash is doubled, and a mark gets one after its first character; ``unescape`` undoes it. Roles other
than system, user and assistant are written, escaped, in the piece.

A conversation's rows are in order of turn (null first), equal turns in order of role and text. Null texts and roles are empty. Rows whose
conv_id is null are one conversation. Repeated rows are turns of their own. Other columns are not read. All turns of
a conversation pass one task in order, one after the other. The digests are read from the examples themselves, spelled out one at a
time: a task holds the text of one conversation, and its time goes by the length of all examples together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import small_batches

# The marks of the template.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<role>", "</role>", "<end>")  # around the name of another role, then after its text
CONTROLS = [m for pair in MARKS.values() for m in pair] + list(OTHER)
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))) + r"|\\")
_ESCAPED = re.compile(r"\\(\\?)")
TARGET = "assistant"

PIECES = "seq bigint, piece string, begin bigint, example bigint, loss_begin bigint, loss_end bigint, end bigint"
_NAMES = ["conv_id", "seq", "piece", "begin", "example", "loss_begin", "loss_end", "end"]
_KINDS = [pa.int64(), pa.string(), *[pa.int64()] * 5]


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m.group() == "\\" else m.group()[0] + "\\" + m.group()[1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The piece of a turn, and where its text begins and ends in it."""
    before, after = MARKS.get(role) or (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def parse(piece: str) -> tuple[str, str]:
    """(role, text) of a piece."""
    for role, (before, after) in MARKS.items():
        if piece.startswith(before) and piece.endswith(after):
            return role, unescape(piece[len(before) : len(piece) - len(after)])
    role, text = piece[len(OTHER[0]) : -len(OTHER[2])].split(OTHER[1], 1)
    return unescape(role), unescape(text)


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted text. Escaped texts hold no mark, so the next one ends a turn."""
    at = 0
    while at < len(text):
        after = next((after for before, after in MARKS.values() if text.startswith(before, at)), OTHER[2])
        end = text.index(after, at) + len(after)
        yield parse(text[at:end])
        at = end


def formatted(conversations: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, seq, its piece and where it begins in the conversation's formatted text.

    Where it ends an example: the example's number, loss span and end, as offsets in the formatted text, of which
    the example is the prefix up to ``end``.
    """
    small_batches(conversations.sparkSession)
    key = conversations.schema["conv_id"].dataType.simpleString()
    turns = (
        conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seq, at, example, waiting, kind = object(), 0, 0, 0, None, None

        def made(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *_KINDS], strict=True)], _NAMES)

        for batch in batches:
            kind, rows = batch.schema.field("conv_id").type, []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv_id != conv:
                    if waiting:  # the last turn of the conversation before
                        rows.append(waiting)
                    conv, seq, at, example = conv_id, 0, 0, 0
                elif waiting:  # followed by more turns, and no target: not the end of an example
                    rows.append((*waiting[:4], None, None, None, None))
                waiting = None
                piece, begin, end = render(role, text)
                if role == TARGET:
                    rows.append((conv_id, seq, piece, at, example, at + begin, at + end, at + len(piece)))
                    example += 1
                else:
                    waiting = (conv_id, seq, piece, at, example, at + len(piece), at + len(piece), at + len(piece))
                seq, at = seq + 1, at + len(piece)
            yield made(rows)
        if waiting:
            yield made([waiting])

    return turns.mapInArrow(run, f"conv_id {key}, {PIECES}")


def texts(pieces: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_begin, loss_end): every example spelled out, with code point offsets of its loss.

    This output repeats contexts, so it grows with the square of a conversation's turns.
    """
    ends = pieces.where("example is not null").select(F.col("conv_id").alias("c"), F.col("seq").alias("last"), F.col("example").alias("e"), F.col("loss_begin").alias("lb"), F.col("loss_end").alias("le"))
    joined = pieces.join(ends, pieces["conv_id"].eqNullSafe(ends["c"]) & (pieces["seq"] <= ends["last"]))
    return joined.groupBy("conv_id", F.col("e").alias("example"), F.col("lb").alias("loss_begin"), F.col("le").alias("loss_end")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda p: p["piece"]), "").alias("text")
    )


def digests(pieces: DataFrame) -> DataFrame:
    """Read the examples back, each spelled out as the prefix it refers to: a row for each conversation.

    The turns are those of its last example, which has them all; the loss is what lies under the masks of all.
    """
    key = pieces.schema["conv_id"].dataType.simpleString()
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, kind = None, [], None

        def made(states: list) -> pa.RecordBatch:
            rows = []
            for conv_id, text, loss_chars, loss, chars, examples in states:
                count, turns = 0, hashlib.sha256()
                for role, said in turns_of(text):
                    count += 1
                    turns.update(f"{role}\n{said}\n".encode())
                rows.append((conv_id, count, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, examples))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds], strict=True)], names)

        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state is not None:
                        done.append(state)
                    state, held = [row["conv_id"], "", 0, hashlib.sha256(), 0, 0], []
                held.append(row["piece"])
                if row["example"] is not None:
                    held = ["".join(held)]
                    example = state[1] = held[0][: row["end"]]
                    loss = unescape(example[row["loss_begin"] : row["loss_end"]])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                    state[4] += len(example)
                    state[5] += 1
            yield made(done)
        if state is not None:
            yield made([state])

    return ordered.mapInArrow(
        run, f"conv_id {key}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint"
    )
