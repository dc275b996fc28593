"""Column functions on text: folding, grams, lines, trimming, JSON and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gramlode.constants import ASCII_LOWER, ASCII_UPPER, FOLDING_TO_ASCII

_NO_STRINGS = "array<string>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fold(col: Column, source: str, target: str) -> Column:
    # Pure ASCII rows (one byte per character) take the byte-wise ``lower``.
    pure = F.octet_length(col) == F.length(col)
    return F.when(pure, F.lower(col)).otherwise(F.translate(col, source, target))


def ascii_lower(col: Column | str) -> Column:
    """Lowercase ``A-Z`` only; every other character stays."""
    return _fold(_col(col), ASCII_UPPER, ASCII_LOWER)


def gram_text(col: Column | str) -> Column:
    """The text grams are cut from: ASCII-lowered, with U+212A and U+017F as ``k`` and ``s``.

    The extra folding makes the grams serve case-insensitive regexes too; it can only add
    candidates, and the verified text is never folded this way.
    """
    extra = "".join(FOLDING_TO_ASCII)
    return _fold(_col(col), ASCII_UPPER + extra, ASCII_LOWER + "".join(FOLDING_TO_ASCII.values()))


def fold_gram_text(text: str) -> str:
    """``gram_text`` for a string on the driver."""
    table = str.maketrans({**dict(zip(ASCII_UPPER, ASCII_LOWER)), **FOLDING_TO_ASCII})
    return text.translate(table)


def ascii_lower_str(text: str) -> str:
    """``ascii_lower`` for a string on the driver."""
    return text.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))


def _windows(col: Column, n: int) -> Column:
    # The lookahead captures the window, the final dot advances by one whole code point.
    return F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def distinct_ngrams(col: Column | str) -> Column:
    """All distinct two- and three-character windows of ``gram_text(col)``, line breaks included.

    Every two-character window except the last is the head of a three-character one, so only the
    trigrams are cut from the text; the bigrams come from the (far fewer) distinct trigrams.
    """
    text = gram_text(col)
    last_pair = F.when(F.length(text) >= 2, F.array(F.right(text, F.lit(2)))).otherwise(
        F.array().cast(_NO_STRINGS)
    )

    def with_bigrams(trigrams: Column) -> Column:
        heads = F.transform(trigrams, lambda g: F.substring(g, 1, 2))
        return F.concat(trigrams, F.array_distinct(F.concat(heads, last_pair)))

    # A transform over a one-element array evaluates the trigrams once for both uses.
    once = F.array(F.array_distinct(_windows(text, 3)))
    return F.get(F.transform(once, with_bigrams), F.lit(0))


def query_ngrams_col(col: Column | str) -> Column:
    """Grams a needle column requires: the bigram for 2 characters, else the trigrams."""
    text = gram_text(col)
    return F.when(F.length(text) == 2, F.array(text)).otherwise(F.array_distinct(_windows(text, 3)))


def query_ngrams(*literals: str) -> list[str]:
    """Grams one or more literal strings require, sorted; none for 0 or 1 characters."""
    grams: set[str] = set()
    for literal in map(fold_gram_text, literals):
        if len(literal) == 2:
            grams.add(literal)
        else:
            grams.update(literal[i : i + 3] for i in range(len(literal) - 2))
    return sorted(grams)


def trim_end(col: Column | str) -> Column:
    """Drop trailing Unicode white space, carriage returns included."""
    return F.regexp_replace(_col(col), r"[\p{IsWhite_Space}]+$", "")


def without_return(line: Column) -> Column:
    """A line without the carriage return at its end."""
    return F.when(F.endswith(line, F.lit("\r")), F.left(line, F.length(line) - 1)).otherwise(line)


def lines_of(col: Column | str, regex: bool = False) -> Column:
    """Lines as an array of strings, split at ``\\n``.

    In regex mode one trailing carriage return per line is dropped, and so is an empty last line.
    """
    text = _col(col)
    if not regex:
        return F.split(text, "\n", -1)
    body = F.when(F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)).otherwise(text)
    lines = F.transform(F.split(body, "\n", -1), without_return)
    return F.when(text == "", F.array().cast(_NO_STRINGS)).otherwise(lines)


def split_lines(df, text: str = "text", regex: bool = False):
    """One row per line: the other columns, then ``line`` (from 1) and ``text``."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(lines_of(text, regex)).alias("_pos", "text")).select(
        *keep, (F.col("_pos") + 1).cast("int").alias("line"), "text"
    )


def rfc3339(col: Column | str) -> Column:
    """UTC time stamp text with second precision (session zone UTC)."""
    return F.date_format(_col(col), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_millis(col: Column | str) -> Column:
    """Modification time in ms since 1970, 0 when unknown."""
    return F.coalesce(F.unix_millis(_col(col)), F.lit(0).cast("bigint"))


def hit_json(file: str = "file", line: str = "line", text: str = "text") -> Column:
    """A hit as a JSON object."""
    return F.to_json(F.struct(F.col(file).alias("file"), F.col(line).alias("line"), F.col(text).alias("text")))
