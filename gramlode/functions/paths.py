"""Path columns: globs, roots, relative paths and path parts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gramlode.constants import UTF8
from gramlode.functions.encodings import canonical_encoding
from gramlode.functions.regex import quote


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_WILD = {"**": ".*", "**/": ".*", "*": "[^/]*", "?": "[^/]"}
_GLOB = re.compile(r"\*\*/?|[*?]|[^*?]+")


def glob_to_regex(pattern: str) -> str:
    """Unanchored regex of a path glob.

    ``**`` crosses separators and takes one following slash with it; ``*`` and ``?`` do not cross.
    """
    return _GLOB.sub(lambda m: _WILD.get(m[0]) or quote(m[0]), pattern)


def path_matches(path: Column | str, pattern: str) -> Column:
    """Does a path match a filter: a glob if it has wildcards, else a case-insensitive substring.

    A blank pattern matches every path.
    """
    wanted = pattern.strip()
    if not wanted:
        return F.lit(True)
    if "*" in wanted or "?" in wanted:
        return _col(path).rlike("(?iu)" + glob_to_regex(wanted))
    return F.contains(F.lower(_col(path)), F.lit(wanted.lower()))


def rel_path(path: Column | str, root: Column | str) -> Column:
    """Path relative to ``root`` (a column, or a literal given with ``F.lit``); else unchanged."""
    path, prefix = _col(path), F.concat(F.rtrim(_col(root), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def base_name(path: Column | str) -> Column:
    """Last component of a path."""
    return F.substring_index(_col(path), "/", -1)


def dir_name(path: Column | str) -> Column:
    """Everything before the last slash, empty when there is none."""
    return F.regexp_replace(_col(path), r"(?s)/?[^/]*\z", "")


def ancestors(path: Column | str) -> Column:
    """All directories above a path, nearest last: ``/a/b/c`` gives ``['', '/a', '/a/b']``."""
    path = _col(path)
    depth = F.size(F.split(path, "/", -1)) - 1
    upto = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    parts = F.split(path, "/", -1)
    return F.transform(upto, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def root_spec_path(spec: Column | str) -> Column:
    """Path part of ``path@encoding``; the split is at the last ``@``."""
    return F.when(_has_suffix(spec), F.regexp_extract(_col(spec), _SPEC, 1)).otherwise(_col(spec))


def root_spec_encoding(spec: Column | str) -> Column:
    """Canonical encoding of ``path@encoding``, UTF-8 without a suffix."""
    suffix = F.regexp_extract(_col(spec), _SPEC, 2)
    return F.when(_has_suffix(spec), canonical_encoding(suffix)).otherwise(UTF8)


_SPEC = r"(?s)\A(.*)@([^@]+)\z"


def _has_suffix(spec: Column | str) -> Column:
    return _col(spec).rlike(_SPEC)
