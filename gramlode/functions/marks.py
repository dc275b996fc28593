"""Where a query matches within a hit line, and the line as marked-up HTML."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gramlode.constants import MAX_RANGES
from gramlode.functions.regex import check_java, quote, to_java

# --- fixed values -----------------------------------------------------------
RANGES = "array<struct<start:int,end:int>>"
# Two code points that are never characters enclose a match; a third takes their place in a text.
_OPEN, _CLOSE, _NEITHER = "\ufdd0", "\ufdd1", "\ufdd2"
HTML_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}
# ----------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def match_ranges(
    text: Column | str,
    query: str,
    *,
    regex: bool = False,
    case_sensitive: bool = False,
    limit: int | None = MAX_RANGES,
) -> Column:
    """Non-overlapping [start, end) of the matches in a line, in characters; the first ``limit``, or all.

    Substrings compare by Unicode lower case. Empty regex matches are passed over, and a pattern
    that is not valid marks nothing.
    """
    text = _col(text)
    if not query:
        return F.array().cast(RANGES)
    if regex:
        try:
            pattern = ("(?U)" if case_sensitive else "(?iU)") + to_java(query, not case_sensitive)
            check_java(SparkSession.active(), pattern)
        except ValueError:
            return F.array().cast(RANGES)
    else:
        text, query = (text, query) if case_sensitive else (F.lower(text), query.lower())
        pattern = quote(query)
    plain = F.translate(text, _OPEN + _CLOSE, _NEITHER * 2)
    marked = F.regexp_replace(plain, pattern, f"{_OPEN}$0{_CLOSE}")
    pieces = F.split(F.replace(marked, F.lit(_OPEN + _CLOSE), F.lit("")), _OPEN, -1)
    begin = F.struct(
        F.length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast(RANGES).alias("found")
    )

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.instr(piece, _CLOSE) - 1
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        found = F.concat(acc["found"], one)
        if limit is not None:
            found = F.when(F.size(acc["found"]) < limit, found).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), found.alias("found"))

    rest = F.slice(pieces, F.lit(2), F.size(pieces))
    return F.aggregate(rest, begin, step, lambda acc: acc["found"])


def first_column(text: Column | str, query: str, **options) -> Column:
    """Start of the first match, 0 when there is none."""
    return F.coalesce(F.get(match_ranges(text, query, **options), F.lit(0))["start"], F.lit(0))


def escape_html(col: Column | str) -> Column:
    """Replace the four characters that HTML gives a meaning."""
    out = _col(col)
    for char, entity in HTML_ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def highlight(text: Column | str, query: str, **options) -> Column:
    """The line in HTML with each match in ``<span class="hl">``."""
    text = _col(text)

    def part(start: Column, end: Column) -> Column:
        return escape_html(F.substr(text, start + 1, end - start))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("html"))

    def step(acc: Column, r: Column) -> Column:
        span = F.concat(F.lit('<span class="hl">'), part(r["start"], r["end"]), F.lit("</span>"))
        html = F.concat(acc["html"], part(acc["at"], r["start"]), span)
        return F.struct(r["end"].alias("at"), html.alias("html"))

    return F.aggregate(
        match_ranges(text, query, **options), begin, step,
        lambda acc: F.concat(acc["html"], part(acc["at"], F.length(text))),
    )
