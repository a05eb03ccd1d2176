"""A lexer for the script dialect, and helpers that work on token lists.

Scripts are rewritten at the level of tokens: constructs that Spark SQL lacks are
replaced, and all the rest goes to Spark's own parser untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""
      (?P<doc>/\*\*(?!/).*?\*/)
    | (?P<hint>/\*\+.*?\*/)
    | (?P<comment>--[^\n]*|/\*.*?\*/)
    | (?P<space>\s+)
    | (?P<string>'(?:[^']|'')*')
    | (?P<quoted>`(?:[^`]|``)*`|"(?:[^"]|"")*")
    | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    | (?P<word>[A-Za-z_$][A-Za-z0-9_$]*)
    | (?P<op>:=|<=|>=|<>|!=|\|\||::|=>|->|.)
    """,
    re.VERBOSE | re.DOTALL,
)
SKIPPED = ("comment", "space", "doc", "hint")
OPEN, CLOSE = {"(": ")", "[": "]"}, {")", "]"}


class ScriptError(ValueError):
    """A mistake in a script, with its place."""

    def __init__(self, message: str, line: int = 0):
        super().__init__(f"line {line}: {message}" if line else message)
        self.line = line


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int = 0

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text

    @property
    def name(self) -> str:
        """An identifier without its quotes."""
        return self.text[1:-1].replace(self.text[0] * 2, self.text[0]) if self.kind == "quoted" else self.text

    @property
    def is_name(self) -> bool:
        return self.kind in ("word", "quoted")


def lex(text: str) -> list[Token]:
    """All tokens, white space and comments included."""
    out, line = [], 1
    for m in _TOKEN.finditer(text):
        out.append(Token(m.lastgroup, m[0], line))
        line += m[0].count("\n")
    depth = 0
    for t in out:
        if t.kind == "op":
            depth += (t.text in OPEN) - (t.text in CLOSE)
            if t.text == "'":
                raise ScriptError("a string has no end", t.line)
    return out


def significant(tokens: Iterable[Token]) -> list[Token]:
    return [t for t in tokens if t.kind not in SKIPPED]


def sql(tokens: Iterable[Token]) -> str:
    """Text that Spark parses: comments go, double-quoted identifiers get back quotes, string escapes are kept literal."""
    parts = []
    for t in tokens:
        if t.kind in ("comment", "doc", "hint"):
            parts.append(" ")
        elif t.kind == "quoted":
            parts.append("`" + t.name.replace("`", "``") + "`")
        elif t.kind == "string" and "\\" in t.text and "''" not in t.text:
            parts.append("r" + t.text)  # the dialect has no backslash escapes
        elif t.kind == "string":
            parts.append(t.text.replace("\\", "\\\\").replace("''", "\\'") if "''" in t.text[1:-1] else t.text)
        else:
            parts.append(t.text)
    return "".join(parts).strip()


def closing(tokens: list[Token], at: int) -> int:
    """Place of the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i].kind == "op":
            depth += (tokens[i].text in OPEN) - (tokens[i].text in CLOSE)
            if depth == 0:
                return i
    raise ScriptError("a bracket is not closed", tokens[at].line)


def after(tokens: list[Token], at: int) -> int:
    """Place of the next significant token from ``at`` on, or the end."""
    while at < len(tokens) and tokens[at].kind in SKIPPED:
        at += 1
    return at


def before(tokens: list[Token], at: int) -> int:
    """Place of the significant token before ``at``, or -1."""
    at -= 1
    while at >= 0 and tokens[at].kind in SKIPPED:
        at -= 1
    return at


def split(tokens: list[Token], separator: str = ",") -> list[list[Token]]:
    """Parts between separators outside of brackets; none for tokens without any significant one."""
    parts, depth = [[]], 0
    for t in tokens:
        if t.kind == "op":
            depth += (t.text in OPEN) - (t.text in CLOSE)
        if depth == 0 and t.upper == separator:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts if significant(tokens) else []


def find(tokens: list[Token], *words: str, start: int = 0) -> int:
    """Place of the first of a run of words outside of brackets, or -1."""
    depth = 0
    for i in range(start, len(tokens)):
        t = tokens[i]
        if t.kind == "op":
            depth += (t.text in OPEN) - (t.text in CLOSE)
        if depth == 0 and t.upper == words[0]:
            j, matched = i, True
            for w in words[1:]:
                j = after(tokens, j + 1)
                if j >= len(tokens) or tokens[j].upper != w:
                    matched = False
                    break
            if matched:
                return i
    return -1
