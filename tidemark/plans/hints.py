"""Hints: ``/*+ name(arg, ...), name */`` before a statement."""

from __future__ import annotations

from dataclasses import dataclass, field

from .tokens import ScriptError, Token, after, closing, lex, split, sql

#: Index kinds and units of retention.
INDEX_KINDS = ("HASH", "BTREE", "PBTREE", "TEXT", "VECTOR_COSINE", "VECTOR_EUCLID")
UNITS = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86400, "WEEK": 604800, "MONTH": 2592000, "YEAR": 31536000}
INSERT_MODES = ("SINGLE", "BATCH", "TRANSACTION")
COLUMN_HINTS = ("primary_key", "partition_key", "query_by_all", "query_by_any")
PLAIN_HINTS = ("no_query", "workload", "test", "ttl", "cache", "engine", "exec", "row_count", "insert", "maintenance", "filtered_distinct_order", "index", "vector_dim")


@dataclass
class Hints:
    """The hints of a statement by name; repeated ones (index) keep all their arguments."""

    by_name: dict[str, list[list[str]]] = field(default_factory=dict)
    unknown: list[str] = field(default_factory=list)

    def __contains__(self, name: str) -> bool:
        return name in self.by_name

    def args(self, name: str) -> list[str] | None:
        return self.by_name[name][0] if name in self.by_name else None

    @property
    def columns(self) -> list[str]:
        """Columns that hints name, to be checked against the table."""
        out = [c for name in COLUMN_HINTS for args in self.by_name.get(name, []) for c in args]
        out += [c for args in self.by_name.get("index", []) for c in args[1:]]
        out += [args[0] for args in self.by_name.get("vector_dim", [])]
        return out + [c for args in self.by_name.get("row_count", []) for c in args[:-1]]

    def seconds(self, name: str) -> int | None:
        """The duration that ``ttl`` or ``cache`` gives."""
        args = self.args(name)
        return None if args is None else duration(" ".join(args))

    @property
    def row_count(self) -> int | None:
        args = self.args("row_count")
        return int(args[-1]) if args else None


def duration(text: str) -> int:
    """Seconds of ``5 minutes``, ``1 day`` and the like."""
    parts = text.replace("'", "").split()
    unit = parts[1].upper().rstrip("S") if len(parts) == 2 else ""
    if len(parts) != 2 or not parts[0].isdigit() or unit not in UNITS:
        raise ScriptError(f"not a duration: {text}")
    return int(parts[0]) * UNITS[unit]


def parse_hints(text: str, line: int = 0) -> Hints:
    """``text``: one hint comment with its marks."""
    tokens = lex(text.strip()[3:-2])
    out = Hints()
    for part in split(tokens):
        at = after(part, 0)
        if at >= len(part):
            continue
        if not part[at].is_name:
            raise ScriptError(f"not a hint: {sql(part)}", line)
        name, args, nxt = part[at].text.lower(), [], after(part, at + 1)
        if nxt < len(part):
            if part[nxt].text != "(":
                raise ScriptError(f"not a hint: {sql(part)}", line)
            inner = part[nxt + 1 : closing(part, nxt)]
            args = [_plain(x) for x in split(inner)]
        name = "engine" if name == "exec" else name
        if name not in COLUMN_HINTS and name not in PLAIN_HINTS:
            out.unknown.append(name)
            continue
        _check(name, args, line)
        out.by_name.setdefault(name, []).append(args)
    return out


def _plain(tokens: list[Token]) -> str:
    return "".join(t.name if t.kind == "quoted" else t.text for t in tokens).strip()


def _check(name: str, args: list[str], line: int) -> None:
    if name in COLUMN_HINTS and not args:
        raise ScriptError(f"hint {name} needs columns", line)
    if name == "row_count" and (not args or not args[-1].isdigit()):
        raise ScriptError("hint row_count needs a number as its last argument", line)
    if name == "vector_dim" and (len(args) != 2 or not args[1].isdigit() or int(args[1]) < 1):
        raise ScriptError("hint vector_dim needs a column and a positive dimension", line)
    if name == "index" and args and args[0].upper() not in INDEX_KINDS:
        raise ScriptError(f"hint index: the kind must be one of {', '.join(INDEX_KINDS)}", line)
    if name == "insert" and (len(args) != 1 or args[0].upper() not in INSERT_MODES):
        raise ScriptError(f"hint insert needs one of {', '.join(INSERT_MODES)}", line)
    if name in ("ttl", "cache"):
        duration(" ".join(args))
    if name == "engine" and len(args) != 1:
        raise ScriptError("hint engine needs one name", line)
