"""Ignore rules: one line of an ignore file as a regular expression on a relative path."""

from __future__ import annotations

import re
from typing import NamedTuple

from gramlode.functions.regex import quote

# --- fixed values -----------------------------------------------------------
# Files that hold rules, by rising precedence.
RULE_FILES = (".git/info/exclude", ".gitignore", ".ignore")
# ----------------------------------------------------------------------------


class Rule(NamedTuple):
    regex: str          # matches the path relative to the directory of the rule file
    negated: bool
    dir_only: bool


def parse_rule(line: str) -> Rule | None:
    """A rule line; ``None`` for blanks and comments."""
    line = re.sub(r"(?<!\\)[ \t\r]+$", "", line.rstrip("\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[1:] if negated else line
    dir_only = body.endswith("/")
    body = body.rstrip("/") if dir_only else body
    if not body:
        return None
    anchored = "/" in body
    inner = _glob(body.removeprefix("/"))
    return Rule(("^" if anchored else "^(?:.*/)?") + inner + "$", negated, dir_only)


_GLOB = re.compile(
    r"(?P<lead>^\*\*/)|(?P<mid>/\*\*(?=/))|(?P<tail>/\*\*$)|(?P<star>\*+)|(?P<one>\?)"
    r"|(?P<set>\[!?\^?\]?[^\]]*\])|\\(?P<escaped>.)|(?P<char>.)",
    re.S,
)


def _glob(body: str) -> str:
    """Glob with ``*`` and ``?`` inside a path component and ``**`` across them."""
    wild = {"lead": "(?:.*/)?", "mid": "(?:/.*)?", "tail": "/.+", "star": "[^/]*", "one": "[^/]"}

    def piece(m: re.Match) -> str:
        kind, text = m.lastgroup, m[m.lastgroup]
        if kind in wild:
            return wild[kind]
        if kind == "set":
            negate, members = re.match(r"\[([!^]?)(.*)\]$", text, re.S).groups()
            members = re.sub(r"([\[\]&\\])", r"\\\1", members)
            return f"[{'^/' if negate else ''}{members}]"
        return quote(text)

    return _GLOB.sub(piece, body)


def parse_rules(text: str) -> list[Rule]:
    """The rules of an ignore file in order; later ones win."""
    return [r for r in map(parse_rule, text.split("\n")) if r]
