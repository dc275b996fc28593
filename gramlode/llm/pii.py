"""Personal data by weak supervision.

*Base* spans (emails, IP addresses, card and phone numbers by fixed rules) are always kept. Wider patterns
propose further candidates: addresses spelled with "(at)" and "(dot)", phone numbers without a plus sign, card
numbers of other lengths or with a failing check digit, dotted numbers with more parts. Labelers vote on
every candidate, for, against, or not at all: the base rule (regex), checksums and ranges, a gazetteer of
name endings, card issuers and dialling codes, the words before the candidate (context), and the characters
that touch it (shape). Expectation-maximisation estimates, for each kind, how reliable each labeler is, from how
often each pattern of votes occurs in all documents; the posteriors train a logistic span classifier
on votes and shapes. Candidates that it scores at ``ACCEPT`` or more, and that meet no base span, are added.

What reaches the driver are counts by (kind, votes, shape), a few thousand cells at most however many documents there are.
All rules are linear in the length of a text, up to the sorting of its spans. Null texts are empty and have no spans. Rows are handled alone:
repeated rows and repeated or null doc_ids keep their rows. Other columns are not read by ``find``;
``redact`` returns them as they are, whatever their names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gramlode.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.8
N_LABELERS = 5
EM_ROUNDS = 50

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# candidates beyond the base rules; every part has a length limit, so that no text takes long
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT|@)[\])]\x20?[A-Za-z0-9-]{1,63}"
    r"(?:\x20?(?:\.|[\[(](?:dot|DOT|\.)[\])])\x20?[A-Za-z0-9-]{1,63}){1,8}"
)
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}[\x20.-])?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])")

# Public name endings, issuer digits, words that speak for or against personal data.
ENDINGS = frozenset("com org net edu gov info io de fr es it uk us eu ch at nl be pl se jp cn ru br in au ca".split())
ISSUERS = frozenset("2 3 4 5 6".split())
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91".split())
FOR = frozenset("email e-mail mail contact write call phone tel telephone mobile fax reach card visa mastercard credit payment ip address host server client telefon téléphone teléfono correo adresse karte carte tarjeta".split())
AGAINST = frozenset("version order invoice sha hash token isbn issn sku serial part model id uuid build section chapter".split())
_WORD_BEFORE = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            end = domain.end()
            yield begin, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed rules, by kind, then start."""
    found = [(0, s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for kind, rule in ((1, _ips), (2, _cards), (3, _phones)):
            found += [(kind, s, e) for s, e in rule(text)]
    return found


def wider_spans(text: str) -> list[tuple[int, int, int]]:
    """Candidates of the wider patterns, base spans among them or not."""
    found = [(0, *m.span()) for m in _SPELLED.finditer(text)] if "(" in text or "[" in text else []
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if m.group().count(".") >= 3 and m.end() - m.start() < 40:
                found.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 40 and 13 <= len(_digits(m.group())) <= 19:
                found.append((2, *m.span()))
        found += [(3, *m.span()) for m in _NATIONAL.finditer(text)]
    return found


def _votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, ...]:
    span, digits = text[start:end], _digits(text[start:end])
    if kind == 0:
        ending = re.split(r"[.\])\x20]+", span)[-1].lower()
        checks = 1 if 2 <= len(ending) <= 12 and ending.isalpha() else -1
        listed = 1 if ending in ENDINGS else 0
    elif kind == 1:
        parts = span.split(".")
        checks = 1 if len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) else -1
        listed = -1 if parts[0].lstrip("0") == "" else 0
    elif kind == 2:
        checks = 1 if luhn(digits) else -1
        listed = 1 if digits[0] in ISSUERS else -1
    else:
        checks = 1 if 8 <= len(digits) <= 15 else -1
        listed = 1 if any(digits.lstrip("0").startswith(c) for c in CODES) and span[0] in "+0" else 0
    before = {w.lower() for w in _WORD_BEFORE.findall(text[max(0, start - 40) : start])}
    context = (1 if before & FOR else 0) - (1 if before & AGAINST else 0)
    touching = (start > 0 and text[start - 1].isalnum()) + (end < len(text) and text[end].isalnum())
    return (1 if base else 0, checks, listed, context, -1 if touching else 0)


def _cell(kind: int, votes: tuple[int, ...], length: int) -> int:
    """A number for (kind, votes, length class)."""
    cell = kind
    for v in votes:
        cell = cell * 3 + v + 1
    return cell * 8 + min(7, length // 5)


def _open(cell: int) -> tuple[int, np.ndarray, int]:
    length, cell = cell % 8, cell // 8
    votes = []
    for _ in range(N_LABELERS):
        votes.append(cell % 3 - 1)
        cell //= 3
    return cell, np.array(votes[::-1]), length


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Where the union of spans begins and ends, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def candidates(text: str | None) -> list[dict]:
    """Base spans first, by kind and start, then wider candidates that meet no base span and no earlier candidate."""
    text = text or ""
    found = [(k, s, e, True) for k, s, e in base_spans(text)]
    for _, pattern in itertools.groupby(wider_spans(text), key=lambda span: span[0]):  # spans of one pattern do not meet
        starts, ends = _merged([(s, e) for _, s, e, _ in found])
        for kind, s, e in pattern:
            k = bisect.bisect_right(ends, s)
            if k == len(starts) or starts[k] >= e:
                found.append((kind, s, e, False))
    return [
        {"kind": k, "start": s, "end": e, "base": b, "cell": _cell(k, _votes(text, k, s, e, b), e - s)}
        for k, s, e, b in found
    ]


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("cell", pa.int32())]))
_SPANS_SQL = "spans array<struct<kind: int, start: bigint, end: bigint, base: boolean, cell: int>>"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every base span and candidate of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [candidates(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, {_SPANS_SQL}")


def find_in_rows(docs: DataFrame) -> DataFrame:
    """(row, spans): ``find`` with the whole row, as a struct, in place of the doc_id; for ``redact``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("row").field("text").to_pylist()
            yield batch.append_column("spans", pa.array([candidates(t) for t in texts], _SPANS))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL(_SPANS_SQL).fields]))


def estimate(votes: np.ndarray, n: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """P(personal data) of each row of votes (-1, 0, 1) that occurs n times, by expectation-maximisation."""
    share = np.clip(0.5 + 0.2 * votes.sum(1), 0.05, 0.95)
    for _ in range(rounds):
        prior = np.clip((n * share).sum() / n.sum(), 0.01, 0.99)
        like = np.log([1 - prior, prior]) + np.zeros((len(n), 2))
        for k in range(votes.shape[1]):
            for y, p in enumerate((1 - share, share)):
                seen = np.array([(n * p * (votes[:, k] == v)).sum() for v in (-1, 0, 1)]) + 1.0
                like[:, y] += np.log(seen / seen.sum())[votes[:, k] + 1]
        share = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -30, 30)))
    return share


def _design(cells: list[int]) -> np.ndarray:
    rows = []
    for cell in cells:
        kind, votes, length = _open(cell)
        rows.append([*(votes == 1), *(votes == -1), *np.eye(len(KINDS))[kind], *np.eye(8)[length]])
    return np.array(rows, float)


def train(cells: list[int], n: list[int]) -> list[int]:
    """The cells that the final span classifier accepts."""
    if not cells:
        return []
    n = np.array(n, float)
    kinds = np.array([_open(c)[0] for c in cells])
    votes = np.array([_open(c)[1] for c in cells])
    target = np.zeros(len(cells))
    for kind in np.unique(kinds):
        own = kinds == kind
        target[own] = estimate(votes[own], n[own])
    x = _design(cells)
    weight = np.log1p(n) / np.log1p(n).sum()
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(2000):
        gap = weight * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target)
        w, b = w - 0.5 * (x.T @ gap + 1e-4 * w), b - 0.5 * gap.sum()
    score = 1 / (1 + np.exp(-(x @ w + b)))
    return sorted(c for c, s in zip(cells, score, strict=True) if s >= ACCEPT)


def accepted_cells(found: DataFrame) -> list[int]:
    """Train on the candidates of all documents."""
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.cell").count().orderBy("cell").collect()
    return train([r["cell"] for r in counts], [r["count"] for r in counts])


def kept_spans(accepted: list[int]) -> Column:
    """The spans that stay: base ones, and added ones of accepted cells; by kind, then start."""
    cells = F.lit(accepted) if accepted else F.lit([]).cast("array<int>")
    stay = F.filter("spans", lambda s: s["base"] | F.array_contains(cells, s["cell"]))
    return F.array_sort(F.transform(stay, lambda s: F.struct(s["kind"], s["start"], s["end"], s["base"])))


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def digests(found: DataFrame, accepted: list[int]) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)."""
    kept = found.withColumn("kept", kept_spans(accepted)).withColumn("basic", F.filter("kept", lambda s: s["base"]))

    def count(kind: int, name: str) -> Column:
        return F.size(F.filter("basic", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{name}")

    counts = [count(k, name) for k, name in enumerate(KINDS)]
    return kept.select(
        "doc_id", *counts, F.sha2(_line(F.col("basic")).cast("binary"), 256).alias("base_sha256"),
        _line(F.col("kept")).alias("spans"), (F.size("kept") - F.size("basic")).cast("long").alias("n_added"),
    )


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with a mark such as [EMAIL] in place of each span (start, end, kind); spans that overlap get the first's mark."""
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(found: DataFrame, accepted: list[int]) -> DataFrame:
    """The rows of ``find_in_rows``, personal data in ``text`` masked; n_chars, where there is one, fits the new text."""
    columns = [f.name for f in found.schema["row"].dataType]
    kept = kept_spans(accepted)
    touched = found.withColumn("spans", kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(s["start"], s["end"], s["kind"]) for s in own] for own in batch.column("spans").to_pylist()]
            texts = [mask(t, s) for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, batch.schema.field("text").type)], ["row", "text"])

    # only texts with spans travel to Python
    masked = touched.where(F.size("spans") > 0).select("row", F.col("row.text").alias("text"), "spans")
    kind = found.schema["row"].dataType
    masked = masked.mapInArrow(run, StructType([StructField("row", kind), StructField("text", StringType())]))
    plain = touched.where(F.size("spans") == 0).select("row", F.col("row.text").alias("text"))
    rows = masked.unionByName(plain)
    out = []
    for name in columns:
        own = F.col("row").getField(name)
        if name == "text":
            own = F.col("text")
        elif name == "n_chars":
            own = F.when(own.isNotNull(), F.length("text")).cast(kind["n_chars"].dataType)
        out.append(own.alias(name))
    return rows.select(*out)
