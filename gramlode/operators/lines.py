"""Verification: from a text to its matching lines, inside one row.

Everything here works on the text of a single row, so neither the per-file cap nor the one-hit-per-
line rule needs a shuffle, and text never leaves the task that read it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.functions.regex import quote
from gramlode.functions.text import gram_text, lines_of, trim_end

Predicate = Callable[[Column], Column]


def contains_ci(needle: str) -> Predicate:
    """Substring, ignoring the case of ASCII letters only.

    Java's plain ``(?i)`` folds ASCII and nothing else, which spares a lowered copy of the text.
    """
    regex = substring_pattern(needle, False)
    return lambda text: text.rlike(regex)


def substring_pattern(needle: str, case_sensitive: bool) -> str:
    """The Java regex that finds a substring."""
    return ("" if case_sensitive else "(?i)") + quote(needle)


def contains_cs(needle: str) -> Predicate:
    """Substring, case-sensitive."""
    return lambda text: F.contains(text, F.lit(needle))


def regex_line(java_regex: str) -> Predicate:
    """Unanchored regex match of a line."""
    return lambda line: line.rlike(java_regex)


@dataclass(frozen=True)
class Verifier:
    """How the lines of a candidate are checked."""

    on_line: Predicate | None        # None: the needle spans lines
    on_text: Predicate | None        # cheap test of the whole text, None when there is none
    regex: bool = False
    needle: str = ""
    case_sensitive: bool = False
    sets: tuple[tuple[str, ...], ...] = ()   # of grams: a line that matches a regex has one whole set; none: nothing is known

    def matches(self, text: Column, per_file: int | None) -> Column:
        """array<struct<line,text>> of the first ``per_file`` matching lines."""
        if self.on_line is None:
            pattern = F.lit(substring_pattern(self.needle, self.case_sensitive))
            return spanning_lines(text, pattern, self.needle.count("\n"), per_file)
        return lines_where(text, self.on_line, per_file, self.regex, self.sets)


def substring_verifier(needle: str, case_sensitive: bool) -> Verifier:
    test = contains_cs(needle) if case_sensitive else contains_ci(needle)
    return Verifier(None if "\n" in needle else test, test, False, needle, case_sensitive)


def regex_verifier(java_regex: str, sets: tuple[tuple[str, ...], ...] = ()) -> Verifier:
    return Verifier(regex_line(java_regex), None, True, sets=sets)


def numbered(lines: Column) -> Column:
    """array<struct<line,text>> of an array of lines."""
    return F.transform(
        lines, lambda line, i: F.struct((i + 1).cast("int").alias("line"), line.alias("text"))
    )


def first_trimmed(hits: Column, per_file: int | None) -> Column:
    """The first ``per_file`` hits, trailing white space dropped."""
    hits = hits if per_file is None else F.slice(hits, 1, per_file)
    return F.transform(hits, lambda h: F.struct(h["line"].alias("line"), trim_end(h["text"]).alias("text")))


def lines_where(
    text: Column, test: Predicate, per_file: int | None, regex: bool = False, sets: tuple[tuple[str, ...], ...] = ()
) -> Column:
    """The first matching lines of a text, numbered from 1, trailing white space dropped.

    With ``sets`` of grams only lines that have one whole set are tested: looking for grams is cheaper than a regex.
    """
    if not sets:
        return first_trimmed(F.filter(numbered(lines_of(text, regex)), lambda h: test(h["text"])), per_file)
    lines = F.transform(
        lines_of(text, regex), lambda line, i: F.struct((i + 1).cast("int").alias("line"), line.alias("text"), gram_text(line).alias("cut"))
    )

    def has(cut: Column) -> Column:
        return reduce(Column.__or__, (reduce(Column.__and__, (F.contains(cut, F.lit(g)) for g in s)) for s in sets))

    return first_trimmed(F.filter(lines, lambda h: has(h["cut"]) & test(h["text"])), per_file)


def spanning_lines(text: Column, pattern: Column, inside: Column | int, per_file: int | None) -> Column:
    """Lines on which a needle with ``inside`` line breaks, given as a quoted regex, starts.

    The text is cut at the non-overlapping occurrences, left to right; the line of an occurrence is
    one more than the line breaks before it.
    """
    pieces = F.split(text, pattern, -1)
    before = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        at = acc["at"] + F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))
        new = F.coalesce(F.try_element_at(acc["found"], F.lit(-1)) != at, F.lit(True))
        if per_file is not None:
            new = new & (F.size(acc["found"]) < per_file)
        found = F.when(new, F.concat(acc["found"], F.array(at))).otherwise(acc["found"])
        return F.struct((at + inside).alias("at"), found.alias("found"))

    found = F.aggregate(before, start, step, lambda acc: acc["found"])
    lines = F.split(text, "\n", -1)
    return F.transform(
        found, lambda n: F.struct(n.alias("line"), trim_end(F.get(lines, n - 1)).alias("text"))
    )


def hits_of(rows: DataFrame, verifier: Verifier, per_file: int | None, *keep: str) -> DataFrame:
    """One row per matching line of (path, text, keep...): keep..., file, line, text."""
    text = F.col("text")
    if verifier.on_text is not None:
        rows = rows.where(verifier.on_text(text))
    return rows.select(
        *keep, F.col("path").alias("file"), F.inline(verifier.matches(text, per_file)).alias("line", "text")
    )

