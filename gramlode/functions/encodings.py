"""Encoding names and decoding, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gramlode.constants import BINARY_SNIFF_BYTES, ENCODING_ALIASES, EUC_JP, JAVA_CHARSETS, SHIFT_JIS, UTF8


def canonical_encoding(col: Column | str) -> Column:
    """Canonical name of an encoding, whatever its case; unknown names mean UTF-8."""
    name = F.lower(F.col(col) if isinstance(col, str) else col)
    out = F.when(name.isin(*ENCODING_ALIASES[SHIFT_JIS]), SHIFT_JIS)
    return out.when(name.isin(*ENCODING_ALIASES[EUC_JP]), EUC_JP).otherwise(UTF8)


def canonical_encoding_str(name: str) -> str:
    """``canonical_encoding`` for a string on the driver."""
    lowered = name.lower()
    return next((k for k, aliases in ENCODING_ALIASES.items() if lowered in aliases), UTF8)


def is_binary(content: Column | str, sniff: int | None = BINARY_SNIFF_BYTES) -> Column:
    """True when a NUL byte is among the first ``sniff`` bytes, or anywhere."""
    content = F.col(content) if isinstance(content, str) else content
    return F.contains(content if sniff is None else F.substring(content, 1, sniff), F.lit(b"\x00"))


def decode_text(content: Column | str, enc: Column | str) -> Column:
    """Bytes to text; malformed input becomes U+FFFD.

    A byte order mark overrides the encoding and is removed. Shift_JIS and EUC-JP go through the
    Java charsets, for which ``session.configure`` must have been applied.
    """
    content = F.col(content) if isinstance(content, str) else content
    enc = F.col(enc) if isinstance(enc, str) else enc

    def rest(n: int) -> Column:
        return F.substr(content, F.lit(n + 1))

    def starts(mark: bytes) -> Column:
        return F.startswith(content, F.lit(mark))

    def utf8(data: Column) -> Column:
        return F.make_valid_utf8(data.cast("string"))

    return (
        F.when(starts(b"\xef\xbb\xbf"), utf8(rest(3)))
        .when(starts(b"\xff\xfe"), F.decode(rest(2), "UTF-16LE"))
        .when(starts(b"\xfe\xff"), F.decode(rest(2), "UTF-16BE"))
        .when(enc == SHIFT_JIS, F.decode(content, JAVA_CHARSETS[SHIFT_JIS]))
        .when(enc == EUC_JP, F.decode(content, JAVA_CHARSETS[EUC_JP]))
        .otherwise(utf8(content))
    )
