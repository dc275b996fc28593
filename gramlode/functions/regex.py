"""Regular expressions: from the accepted dialect to Java, and the literals a match must contain.

The accepted dialect is that of finite-automaton engines: no look-around, no back-references, no
possessive or atomic groups. Java, which verifies the lines, backtracks: a pattern such as
``(a+)+$`` can take very long on an unlucky line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import regex as unicode_regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gramlode.functions.text import ascii_lower, ascii_lower_str

NO_LITERAL = "the regex has no literal run of at least 2 characters to look up in the index"

# --- fixed values: bracket classes, ASCII only ------------------------------
BRACKET_CLASSES = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
# ----------------------------------------------------------------------------

# Java's Unicode folding takes these two for an i, simple case folding does not.
NOT_I = "\u0130\u0131"

_LITERAL_RUN = r"(?:[a-z0-9_]|[^\x00-\x7F]){2,}"

_TOKENS = re.compile(
    r"""
    (?P<escape>\\(?:[xuU]\{[^}]*\}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}
                  |[pP](?:\{[^}]*\}|[A-Za-z])|b\{[a-z-]+\}|.))
  | (?P<bracket>\[:\^?[a-z]+:\])
  | (?P<class>\[\^?\]?)
  | (?P<endclass>\])
  | (?P<look>\(\?(?:<?[=!]|>))
  | (?P<flags>\(\?[a-zA-Z-]+[:)])
  | (?P<named>\(\?P?<[^>]*>)
  | (?P<group>\((?:\?:)?)
  | (?P<endgroup>\))
  | (?P<repeat>(?:[*+?]|\{[0-9, ]*\})\??)
  | (?P<alt>\|)
  | (?P<any>[.^$])
  | (?P<char>.)
    """,
    re.S | re.X,
)


def quote(text: str) -> str:
    """Escape a literal for Java: every ASCII character that is neither letter nor digit."""
    return re.sub(r"([\x00-\x7F])", lambda m: m[0] if m[0].isalnum() or m[0] == "_" else _escaped(m[0]), text)


def _escaped(ch: str) -> str:
    return "\\" + ch if ch.isprintable() else f"\\x{ord(ch):02X}"


def _tokens(pattern: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, class depth) of each token; inside a class all but brackets are ``char``."""
    depth = 0
    for m in _TOKENS.finditer(pattern):
        kind, text = m.lastgroup, m[0]
        if kind == "class":
            depth += 1
        elif kind == "endclass" and depth:
            depth -= 1
            yield kind, text, depth
            continue
        elif kind == "endclass" or (kind == "bracket" and not depth):
            kind = "char" if kind == "endclass" else "class"
        elif depth and kind not in ("escape", "bracket"):
            yield "char", text, depth
            continue
        yield kind, text, depth


# --------------------------------------------------------------------------- dialect


def to_java(pattern: str, folded: bool = False) -> str:
    """The Java spelling of a pattern, without leading flags; ``ValueError`` if not accepted.

    ``folded`` tells that case is ignored from the start. Where it is, letters fold as in simple case
    folding: an ``i`` is not a dotted capital or a dotless small one.
    """
    out: list[str] = []
    before, last, opened = None, "", 0
    folds = [folded]
    for kind, text, depth in _tokens(pattern):
        piece = text
        if kind == "look":
            raise ValueError("look-around and atomic groups are not supported")
        if kind == "escape":
            piece = _java_escape(text, depth)
        elif kind == "bracket":
            name = text.strip("[:^]")
            if name not in BRACKET_CLASSES:
                raise ValueError(f"unknown bracket class {text}")
            piece = ("[^" if "^" in text else "[") + BRACKET_CLASSES[name] + "]"
        elif kind == "class":
            piece = text.replace("]", "\\]")
            opened = len(out) if depth == 1 else opened
        elif kind == "flags":
            piece = _java_flags(text)
            folds = _with_flags(folds, text)
        elif kind == "named":
            piece = "(?<" + re.sub(r"[^A-Za-z0-9]", "x", text.split("<", 1)[1][:-1]) + ">"
        elif kind == "repeat":
            if before == "repeat":
                raise ValueError("a repetition of a repetition is not supported, use a group")
            piece = re.sub(r"\{,", "{0,", text.replace(" ", ""))
        elif depth and text in ("-", "~") and last == text:
            raise ValueError("class difference is not supported")
        if kind in ("named", "group"):
            folds.append(folds[-1])
        elif kind == "endgroup" and len(folds) > 1:
            folds.pop()
        if folds[-1] and not depth and kind in ("char", "escape"):
            piece = _folded_char(kind, text, piece)
        out.append(piece)
        if kind == "endclass" and not depth and folds[-1]:
            out[opened:] = [_folded_class("".join(out[opened:]))]
        before, last = kind, text
    return "".join(out)


def _with_flags(folds: list[bool], text: str) -> list[bool]:
    """Whether case is ignored, for the groups that are open after a flags token."""
    on, _, off = text[2:-1].partition("-")
    now = "i" in on or (folds[-1] and "i" not in off)
    return [*folds, now] if text.endswith(":") else [*folds[:-1], now]


def _folded_char(kind: str, text: str, piece: str) -> str:
    """A literal i in any spelling, so that it does not take its two look-alikes along."""
    char = text if kind == "char" else None
    if kind == "escape" and text[1] in "xuU" and len(text) > 2:
        char = chr(int(text[2:].strip("{}"), 16))
    if char in ("i", "I"):
        return "(?-i:[iI])"
    return f"(?-i:{char})" if char and char in NOT_I else piece


def _folded_class(members: str) -> str:
    """A class that ignores case, where i and its look-alikes are in only if the class by itself says so."""
    try:
        exact = unicode_regex.compile(members, unicode_regex.V1)
    except unicode_regex.error:
        return members
    plain = [exact.fullmatch(c) is not None for c in "iI"]
    own = [c for c in NOT_I if exact.fullmatch(c)]
    if all(plain) if members.startswith("[^") else any(plain):
        own += ["i", "I"]
    if not own:
        return members
    other = [c for c in NOT_I + "iI" if c not in own]
    less = f"(?-i:(?![{''.join(other)}]))" if other else ""
    return f"(?:(?-i:[{''.join(own)}])|{less}{members})"


def _java_escape(text: str, depth: int) -> str:
    letter = text[1]
    if letter in "uU" and len(text) > 2:
        return "\\x{" + text[2:].strip("{}") + "}"
    if letter in "pP" and len(text) > 3:
        name = text[3:-1]
        negate = name.startswith("^")
        name = name.lstrip("^")
        if negate:
            letter = {"p": "P", "P": "p"}[letter]
        return f"\\{letter}{{{name if len(name) <= 2 else 'Is' + name}}}"
    if text == "\\v":
        return "\\x0B"
    if text in ("\\<", "\\b{start}"):
        return r"\b(?=\w)"
    if text in ("\\>", "\\b{end}"):
        return r"\b(?<=\w)"
    if text.startswith("\\b{") or (letter.isascii() and letter.isalnum() and letter not in "pPxdDsSwWbBAzaftnr"):
        raise ValueError(f"unsupported escape or back-reference {text}")
    return text


def _java_flags(text: str) -> str:
    # Java's U is the Unicode switch called u here; swapped greediness and CRLF mode do not
    # change whether a single line matches.
    body, end = text[2:-1], text[-1]
    on, _, off = body.partition("-")
    strange = set(on + off) - set("imsuxUR")
    if strange:
        raise ValueError(f"unknown flags {text}")

    def keep(flags: str) -> str:
        return "".join("U" if f == "u" else f for f in flags if f not in "UR")

    on, off = keep(on), keep(off)
    if not on and not off:
        return "(?:" if end == ":" else ""
    return "(?" + on + ("-" + off if off else "") + end


def java_regex(pattern: str, case_sensitive: bool = False) -> str:
    """Full Java regex: Unicode classes and folding, only ``\\n`` ends a line."""
    return ("(?dU)" if case_sensitive else "(?diU)") + to_java(pattern, not case_sensitive)


def nested_repeats(pattern: str) -> bool:
    """Does a group that holds an unbounded repetition repeat without bound itself, as in ``(a+)+``?

    Java can take a time exponential in the line on such patterns.
    """
    unbounded = re.compile(r"[*+]|\{\d*,\}")
    holds, last = [False], False    # for each open group; for the group that just ended
    for kind, text, depth in _tokens(pattern):
        if depth:
            continue
        if kind in ("group", "named") or (kind == "flags" and text.endswith(":")):
            holds.append(False)
        elif kind == "endgroup" and len(holds) > 1:
            last = holds.pop()
            holds[-1] |= last
            continue
        elif kind == "repeat" and unbounded.match(text):
            if last:
                return True
            holds[-1] = True
        last = False
    return False


def check_java(spark: SparkSession, regex: str) -> None:
    """Raise ``ValueError`` on the driver when Java rejects the regex."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(regex)
    except Exception as e:  # py4j wraps the Java exception
        raise ValueError(f"invalid regex: {str(e).splitlines()[-1][:200]}") from e


# --------------------------------------------------------------------------- literals


def extract_literals(pattern: str) -> list[str]:
    """All runs of word or non-ASCII characters, at least 2 long, ASCII-lowered.

    This looks at the characters only. As a prefilter it can lose matches (``foo|bar`` asks for
    both words); ``required_literals`` is the sound form.
    """
    return re.findall(_LITERAL_RUN, ascii_lower_str(pattern))


def extract_literals_col(col: Column | str) -> Column:
    """``extract_literals`` for a column of patterns."""
    return F.regexp_extract_all(ascii_lower(col), F.lit(f"({_LITERAL_RUN})"), F.lit(1))


def required_literals(pattern: str, case_sensitive: bool = False) -> list[str]:
    """Strings that occur in the gram text of every matching line; may be empty.

    Only runs outside classes and groups count, nothing counts in a pattern with a top-level
    alternation or verbose mode, and a character that may be repeated zero times is cut off.
    Where case is ignored a run ends at each cased character beyond ASCII.
    """
    if re.search(r"\(\?[a-zA-Z-]*x", pattern):
        return []
    folded = not case_sensitive or re.search(r"\(\?[a-zA-Z]*i", pattern)
    runs: list[list[str]] = [[]]
    level = 0
    for kind, text, depth in _tokens(pattern):
        if kind in ("named", "group") or (kind == "flags" and text.endswith(":")) or kind == "look":
            level += 1
        elif kind == "endgroup":
            level = max(level - 1, 0)
        elif level or depth or kind == "endclass":
            pass
        elif kind == "alt":
            return []
        elif kind == "repeat":
            if not text.startswith("+"):
                del runs[-1][-1:]
        else:
            char = _literal_char(kind, text)
            if char and not (folded and _has_case(char)):
                runs[-1].append(char)
                continue
        runs.append([])
    return [ascii_lower_str("".join(r)) for r in runs if len(r) >= 2]


def _literal_char(kind: str, text: str) -> str | None:
    if kind == "char":
        return text
    if kind == "escape" and len(text) == 2 and not text[1].isalnum() and text[1] not in "<>":
        return text[1]
    return None


def _has_case(char: str) -> bool:
    return not char.isascii() and (char.lower() != char or char.upper() != char)
