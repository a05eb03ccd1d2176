"""Queries of the dialect as Spark SQL.

Rewritten are window table functions, temporal joins, table functions, UNNEST, function
calls, types of casts, and one-based subscripts. All other tokens pass unchanged.
"""

from __future__ import annotations

from typing import Protocol

from ..functions.registry import TRANSLATIONS
from .hints import UNITS
from .statements import spark_type
from .tokens import ScriptError, Token, after, before, closing, find, lex, significant, split, sql

WINDOWS = ("TUMBLE", "HOP", "CUMULATE", "SESSION")
#: Words that end a join condition.
ENDS = ("JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "OFFSET")
#: Words before an opening bracket that aren't calls.
NO_CALLS = ("IN", "AND", "OR", "NOT", "ON", "WHERE", "FROM", "JOIN", "SELECT", "AS", "EXISTS", "VALUES", "OVER", "BY", "USING", "WHEN", "THEN", "ELSE", "UNION", "ALL", "SETS", "CASE", "WITH", "LATERAL", "BETWEEN", "ANY", "SOME", "HAVING", "RECURSIVE", "DISTINCT", "LIMIT", "EXCEPT", "INTERSECT")


#: Words that are calls without brackets.
CONSTANTS = {"LOCALTIME": "current_time(0)", "LOCALTIMESTAMP": "localtimestamp()", "CURRENT_TIME": "current_time()", "CURRENT_ROW_TIMESTAMP": "current_timestamp()"}


class Scope(Protocol):
    """What a rewriter asks of the engine."""

    def resolve(self, path: tuple[str, ...]) -> str | None: ...

    def versions(self, name: str) -> tuple[str, list[str]] | None: ...

    def asof_view(self, left: str, right: str, alias: str, keys: list[tuple[str, str]], left_time: str, how: str, used: set[str] | None) -> str: ...

    def binned_view(self, table: str, column: str, low: int, high: int, width: int, name: str) -> str | None: ...

    def range_views(self, left: tuple[str, str], right: tuple[str, str], low: float, high: float, how: str, spread: bool, names: tuple[str, str]) -> tuple[str, str] | None: ...

    def full_view(self, left: str, right: str, names: tuple[str, str], on: list[tuple[str, str]]) -> str | None: ...

    def table_function(self, name: str, args: list[str]) -> str | None: ...

    def changelog(self, name: str) -> str: ...

    def vector_dim(self, column: str) -> int | None: ...

    def window_view(self, kind: str, source: str, ts: str, spans: list[str]) -> str | None: ...


def raw(text: str) -> Token:
    return Token("raw", text)


def interval(tokens: list[Token]) -> str:
    """``INTERVAL '5' SECOND`` as Spark's duration text."""
    words = significant(tokens)
    if len(words) == 3 and words[0].upper == "INTERVAL" and words[1].kind in ("string", "number"):
        return f"{words[1].text.strip(chr(39))} {words[2].upper.rstrip('S')}"
    raise ScriptError(f"not an interval of one unit: {sql(tokens)}", words[0].line if words else 0)


class Rewriter:
    """``linear``: temporal joins of two plain tables become as-of joins by one sort instead of range joins, and interval joins get bins of time."""

    def __init__(self, scope: Scope, linear: bool = True):
        self.scope, self.linear = scope, linear
        self.used_asof = self.used_bins = False

    def query(self, tokens: list[Token]) -> str:
        return sql(self.walk(tokens))

    def text(self, source: str) -> str:
        return self.query(lex(source))

    def walk(self, tokens: list[Token]) -> list[Token]:
        tokens = self._full_join(self._interval_join(self._temporal_joins(tokens)))
        out: list[Token] = []
        i = 0
        while i < len(tokens):
            t = tokens[i]
            nxt = after(tokens, i + 1)
            opens = nxt < len(tokens) and tokens[nxt].text == "("
            if t.kind == "word" and opens and t.upper not in NO_CALLS:
                i = self._call(tokens, i, nxt, out)
            elif t.upper in ("MAP", "ARRAY") and nxt < len(tokens) and tokens[nxt].text == "[":
                end = closing(tokens, nxt)
                out.append(raw(f"{t.upper.lower()}({', '.join(self.query(p) for p in split(tokens[nxt + 1 : end]))})"))
                i = end + 1
            elif t.text == "[":
                end = closing(tokens, i)
                base = self._pop_primary(out)
                out.append(raw(f"try_element_at({base}, {self.query(tokens[i + 1 : end])})"))
                i = end + 1
            elif t.upper in CONSTANTS and not opens and not self._qualified(tokens, i):
                out.append(raw(CONSTANTS[t.upper]))
                i += 1
            elif t.upper == "TIMESTAMP" and nxt < len(tokens) and tokens[nxt].kind == "string":
                out.append(raw("TIMESTAMP_NTZ"))
                i += 1
            elif t.is_name and (path := self._path(tokens, i)) and (name := self.scope.resolve(path[0])):
                out.append(raw(name))
                i = path[1]
            elif t.kind == "op" and t.text == "(":
                end = closing(tokens, i)
                out += [t, *self.walk(tokens[i + 1 : end]), tokens[end]]
                i = end + 1
            else:
                out.append(t)
                i += 1
        return out

    @staticmethod
    def _qualified(tokens: list[Token], i: int) -> bool:
        """Whether the name is a column's or an alias."""
        j, k = before(tokens, i), after(tokens, i + 1)
        return (j >= 0 and tokens[j].upper in (".", "AS")) or (k < len(tokens) and tokens[k].text == ".")

    def _path(self, tokens: list[Token], i: int) -> tuple[tuple[str, ...], int] | None:
        """A table's qualified name after FROM, JOIN, a comma or TABLE."""
        j = before(tokens, i)
        if j < 0 or tokens[j].upper not in ("FROM", "JOIN", ",", "TABLE", "LATERAL"):
            return None
        names, i = [tokens[i].name], i + 1
        while i + 1 < len(tokens) and tokens[i].text == "." and tokens[i + 1].is_name:
            names.append(tokens[i + 1].name)
            i += 2
        if len(names) == 1 and (tokens[j].text == "," or self.scope.resolve((names[0],)) == f"`{names[0]}`"):
            return None  # its view has its name
        return tuple(names), i

    @staticmethod
    def _pop_primary(out: list[Token]) -> str:
        """Takes the expression that a subscript belongs to off the output."""
        end = len(out)
        i = end - 1
        while i >= 0 and out[i].kind in ("space", "comment"):
            i -= 1
        while i >= 0:
            if out[i].text == ")":
                depth = 0
                while i >= 0:
                    depth += (out[i].text == ")") - (out[i].text == "(")
                    if depth == 0:
                        break
                    i -= 1
                if i > 0 and out[i - 1].kind == "word" and out[i - 1].upper not in NO_CALLS:
                    i -= 1
            if i >= 2 and out[i - 1].text == "." and out[i - 2].is_name:
                i -= 2
                continue
            break
        i = max(i, 0)
        base = sql(out[i:])
        del out[i:]
        return base

    # ---- calls

    def _call(self, tokens: list[Token], at: int, opened: int, out: list[Token]) -> int:
        end = closing(tokens, opened)
        name, inner = tokens[at].upper, tokens[opened + 1 : end]
        words = significant(inner)
        first = words[0].upper if words else ""
        if name == "TABLE":
            second = words[1].text if len(words) > 1 else ""
            if second == "(" and (first in WINDOWS or first == "TO_CHANGELOG"):
                i = next(i for i, t in enumerate(inner) if t.text == "(")
                out.append(raw(self._table_valued(first, inner[i + 1 : closing(inner, i)])))
                return end + 1
            if second == "(":
                i = next(i for i, t in enumerate(inner) if t.text == "(")
                args = [self.query(p) for p in split(inner[i + 1 : closing(inner, i)])]
                text = self.scope.table_function(words[0].name, args)
                j = before(out, len(out))
                if text is None:  # a Python table function, which Spark knows
                    out.append(raw(f"{words[0].name}({', '.join(args)})"))
                else:
                    if j >= 0 and out[j].upper not in ("LATERAL",) and self._is_lateral(out):
                        out.append(raw("LATERAL "))
                    out.append(raw(f"({text})"))
                return end + 1
        if name in WINDOWS and first in ("TABLE", "DATA"):
            out.append(raw(self._table_valued(name, inner)))
            return end + 1
        if name == "TO_CHANGELOG" and first == "TABLE":
            out.append(raw(self._table_valued(name, inner)))
            return end + 1
        if name == "UNNEST":
            return self._unnest(tokens, inner, end, out)
        if name in ("CAST", "TRY_CAST") and find(inner, "AS") >= 0:
            as_ = find(inner, "AS")
            out.append(raw(f"{name}({self.query(inner[:as_])} AS {spark_type(inner[as_ + 1 :])})"))
            return end + 1
        if name in ("FLOOR", "CEIL", "CEILING") and find(inner, "TO") >= 0:
            to = find(inner, "TO")
            x, unit = self.query(inner[:to]), sql(inner[to + 1 :])
            cut = f"date_trunc('{unit}', {x})"
            out.append(raw(cut if name == "FLOOR" else f"IF({cut} = {x}, {cut}, timestampadd({unit}, 1, {cut}))"))
            return end + 1
        if name in ("JSON_VALUE", "JSON_QUERY", "JSON_EXISTS", "JSON_OBJECT", "JSON_OBJECTAGG", "JSON_ARRAYAGG"):
            out.append(raw(self._json(name, inner)))
            return end + 1
        if name in TRANSLATIONS:
            args = [self.query(p) for p in split(inner)]
            if name == "CENTER" and len(args) == 1:
                dim = self.scope.vector_dim(args[0].split(".")[-1].strip("`"))
                if dim is None:
                    raise ScriptError("center needs the vector's dimension: center(v, n) or the hint vector_dim", tokens[at].line)
                args.append(str(dim))
            try:
                out.append(raw(TRANSLATIONS[name](*args)))
            except TypeError:
                raise ScriptError(f"{name} does not take {len(args)} arguments", tokens[at].line) from None
            return end + 1
        out += [tokens[at], Token("op", "("), *self.walk(inner), Token("op", ")")]
        return end + 1

    @staticmethod
    def _is_lateral(out: list[Token]) -> bool:
        j = before(out, len(out))
        return j >= 0 and out[j].upper in (",", "JOIN") or (j >= 0 and out[j].upper == "LATERAL")

    def _json(self, name: str, inner: list[Token]) -> str:
        """The SQL standard's JSON functions, with their key words."""
        f = TRANSLATIONS[name]
        if name in ("JSON_OBJECT", "JSON_OBJECTAGG"):
            out = []
            for part in split(inner):
                words = significant(part)
                if words and words[0].upper == "KEY":
                    part = part[next(i for i, t in enumerate(part) if t is words[0]) + 1 :]
                for stop in (("NULL", "ON", "NULL"), ("ABSENT", "ON", "NULL")):
                    cut = find(part, *stop)
                    part = part[:cut] if cut > 0 else part
                value = find(part, "VALUE")
                out += [self.query(part[:value]), self.query(part[value + 1 :])] if value >= 0 else [self.query(part)]
            return f(*out)
        parts = split(inner)
        last, returning = parts[-1], None
        for words in (("RETURNING",), ("NULL", "ON"), ("ERROR", "ON"), ("DEFAULT",), ("WITH",), ("WITHOUT",), ("TRUE", "ON"), ("FALSE", "ON"), ("UNKNOWN", "ON"), ("ABSENT", "ON")):
            cut = find(last, *words)
            if cut > 0:
                if words == ("RETURNING",):
                    rest = last[cut + 1 :]
                    stop = min([x for x in (find(rest, "NULL", "ON"), find(rest, "ERROR", "ON"), find(rest, "DEFAULT")) if x > 0], default=len(rest))
                    returning = spark_type(rest[:stop])
                last = last[:cut]
        args = [self.query(p) for p in [*parts[:-1], last]]
        return f(*args, returning.lower()) if returning and name == "JSON_VALUE" else f(*args)

    def _unnest(self, tokens: list[Token], inner: list[Token], end: int, out: list[Token]) -> int:
        """``UNNEST(x) [AS] e [(a, b)]``: rows of structs keep their name as alias."""
        x = self.query(inner)
        i = after(tokens, end + 1)
        if i < len(tokens) and tokens[i].upper == "AS":
            i = after(tokens, i + 1)
        if i >= len(tokens) or not tokens[i].is_name or tokens[i].upper in (*ENDS, "ON"):
            out.append(raw(f"LATERAL explode({x})"))
            return end + 1
        alias, j = tokens[i].name, after(tokens, i + 1)
        columns: list[str] = []
        if j < len(tokens) and tokens[j].text == "(":
            stop = closing(tokens, j)
            columns, i = [t.name for t in tokens[j:stop] if t.is_name], stop
        if len(columns) > 1:
            call = f"LATERAL inline({x}) AS `{alias}`({', '.join(f'`{c}`' for c in columns)})"
        elif columns:
            call = f"LATERAL explode({x}) AS `{alias}`(`{columns[0]}`)"
        else:
            call = f"LATERAL explode({x}) AS `{alias}_rows`(`{alias}`)"
        out.append(raw(call))
        return i + 1

    # ---- window table functions

    def _table_valued(self, kind: str, inner: list[Token]) -> str:
        parts = [self._named(p) for p in split(inner)]
        source, partition = self._source(parts[0])
        if kind == "TO_CHANGELOG":
            return self.scope.changelog(source)
        words = significant(parts[1])
        if words[0].upper != "DESCRIPTOR":
            raise ScriptError(f"{kind} needs a DESCRIPTOR", words[0].line)
        ts = sql(words[2:-1])
        spans = [interval(p) for p in parts[2:]]
        if view := self.scope.window_view(kind, source, ts, spans):
            return view
        return windowed(kind, source, ts, spans, partition)

    @staticmethod
    def _named(part: list[Token]) -> list[Token]:
        cut = find(part, "=>")
        return part[cut + 1 :] if cut >= 0 else part

    def _source(self, part: list[Token]) -> tuple[str, list[str]]:
        words = significant(part)
        by = find(words, "PARTITION", "BY")
        partition = []
        if by >= 0:
            partition = [sql(p).strip("()") for p in split(words[by + 2 :])]
            words = words[:by]
        if words[0].upper == "TABLE":
            words = words[1:]
        if words[0].text == "(":
            return f"({self.query(part[next(i for i, t in enumerate(part) if t.text == '(') + 1 : closing(part, next(i for i, t in enumerate(part) if t.text == '('))])})", partition
        name = tuple(t.name for t in words if t.is_name)
        return self.scope.resolve(name) or ".".join(f"`{n}`" for n in name), partition

    # ---- temporal joins

    def _temporal_joins(self, tokens: list[Token]) -> list[Token]:
        at = find(tokens, "FOR", "SYSTEM_TIME", "AS", "OF")
        while at >= 0:
            tokens = self._temporal_join(tokens, at)
            at = find(tokens, "FOR", "SYSTEM_TIME", "AS", "OF", start=at)
        return tokens

    def _temporal_join(self, tokens: list[Token], at: int) -> list[Token]:
        line = tokens[at].line
        name_end = before(tokens, at)
        start = name_end
        while start >= 2 and tokens[start - 1].text == ".":
            start -= 2
        right = ".".join(t.name for t in tokens[start : name_end + 1] if t.is_name)
        i = at
        for _ in range(4):
            i = after(tokens, i + 1)
        time = [tokens[i]]
        while i + 2 < len(tokens) and tokens[i + 1].text == ".":
            time += tokens[i + 1 : i + 3]
            i += 2
        i = after(tokens, i + 1)
        if i < len(tokens) and tokens[i].upper == "AS":
            i = after(tokens, i + 1)
        alias = right.split(".")[-1]
        if i < len(tokens) and tokens[i].is_name and tokens[i].upper != "ON":
            alias, i = tokens[i].name, after(tokens, i + 1)
        if i >= len(tokens) or tokens[i].upper != "ON":
            raise ScriptError("a temporal join needs ON", line)
        stop, depth = i + 1, 0
        while stop < len(tokens) and not (depth == 0 and (tokens[stop].upper in ENDS or tokens[stop].text in (",", ")"))):
            depth += (tokens[stop].text == "(") - (tokens[stop].text == ")")
            stop += 1
        condition = tokens[i + 1 : stop]
        found = self.scope.versions(right)
        if found is None:
            raise ScriptError(f"{right} has no versions: a temporal join needs a table of versioned state or a lookup", line)
        view, keys = found
        pairs = self._equalities(condition, alias)
        if not {k.lower() for k in keys} <= {b.lower() for _, b in pairs or self._mentioned(condition, alias)}:
            raise ScriptError(f"a temporal join must equate the whole primary key of {right}: {', '.join(keys)}", line)
        plain = self._plain_left(tokens, start)
        if self.linear and pairs and plain and not (self._starred(tokens[: plain[3]]) and self._joins_more(tokens[stop:])):
            table, left_alias, how, begin = plain
            lefts = [a for a, _ in pairs]
            named = [t.name for t in time if t.is_name]
            if all(len(a) == 2 and a[0].lower() == left_alias.lower() for a in lefts) and named[0].lower() == left_alias.lower() and len(named) == 2:
                self.used_asof = True
                head, starred = self._expanded(tokens[:begin], left_alias, alias)
                mentioned = {b.lower() for _, b in self._mentioned(tokens, alias)}
                made = self.scope.asof_view(table, right, alias, [(a[1], b) for a, b in pairs], named[1], how, None if starred or "*" in mentioned else mentioned)
                return [*head, raw(f"`{made}` AS `{left_alias}` "), *tokens[stop:]]
        t, a = sql(time), f"`{alias}`"
        bounds = f" AND {t} >= {a}.`_valid_from` AND ({a}.`_valid_to` IS NULL OR {t} < {a}.`_valid_to`) "
        return [*tokens[:start], raw(f"`{view}` AS {a} ON ("), *condition, raw(")" + bounds), *tokens[stop:]]

    # ---- interval joins

    def _interval_join(self, tokens: list[Token]) -> list[Token]:
        """The query's first join of two tables, if its condition bounds the distance of their times, or of two numbers, on both sides: with equal bins as well.

        Rows of the right table go to each bin in which a left row may lie that they match (of numbers: those of the smaller
        table), so that a task compares only rows that are near. The condition itself stays.
        """
        at = find(tokens, "JOIN")
        start = after(tokens, at + 1)
        if not self.linear or at < 0 or start >= len(tokens) or not tokens[start].is_name or (plain := self._plain_left(tokens, start)) is None:
            return tokens
        table, left, how, begin = plain
        i, names = start, [tokens[start].name]
        while i + 2 < len(tokens) and tokens[i + 1].text == "." and tokens[i + 2].is_name:
            names.append(tokens[i + 2].name)
            i += 2
        right, i = names[-1], after(tokens, i + 1)
        if i < len(tokens) and tokens[i].upper == "AS":
            i = after(tokens, i + 1)
        if i < len(tokens) and tokens[i].is_name and tokens[i].upper not in ("ON", "FOR", "USING"):
            right, i = tokens[i].name, after(tokens, i + 1)
        if i >= len(tokens) or tokens[i].upper != "ON":
            return tokens
        stop, depth = i + 1, 0
        while stop < len(tokens) and not (depth == 0 and (tokens[stop].upper in ENDS or tokens[stop].text in (",", ")"))):
            depth += (tokens[stop].text == "(") - (tokens[stop].text == ")")
            stop += 1
        condition = tokens[i + 1 : stop]
        for (a, b, numeric), (low, high) in self._bounds(condition, left.lower(), right.lower()).items():
            if low is None or high is None or high < low:
                continue
            mark = f"_bin_{begin}_{start}"
            if numeric:
                views = self.scope.range_views((table, a), (".".join(names), b), low, high, how, not any(t.text == "=" for t in condition), (f"{mark}_l", f"{mark}_r"))
                if views is None:
                    continue
                ours, theirs = views
            else:
                width = max(1, high - low)
                ours = self.scope.binned_view(table, a, 0, 0, width, f"{mark}_l")
                theirs = self.scope.binned_view(".".join(names), b, -high, -low, width, f"{mark}_r")
            if ours is None or theirs is None:
                return tokens
            self.used_bins = True
            head = self._without(tokens[:begin], {None: [f"{mark}_l", f"{mark}_r"], left.lower(): [f"{mark}_l"], right.lower(): [f"{mark}_r"]})
            equal = f") AND `{left}`.`{mark}_l` = `{right}`.`{mark}_r` "
            kind = "LEFT JOIN" if how == "left" else "JOIN"
            return [*head, raw(f"`{ours}` AS `{left}` {kind} `{theirs}` AS `{right}` ON ("), *condition, raw(equal), *tokens[stop:]]
        return tokens

    def _full_join(self, tokens: list[Token]) -> list[Token]:
        """A query's only join, if it is a full one by equal columns of large tables: a view with each side as a struct of its alias's name."""
        at, begin = find(tokens, "FULL"), find(tokens, "FROM")
        join = after(tokens, at + 1)
        if at >= 0 and join < len(tokens) and tokens[join].upper == "OUTER":
            join = after(tokens, join + 1)
        on = find(tokens, "ON")
        if not self.linear or not 0 <= begin < at < join < on or tokens[join].upper != "JOIN" or find(tokens, "UNION") >= 0 or self._starred(tokens[:begin]):
            return tokens
        stop, depth = on + 1, 0
        while stop < len(tokens) and not (depth == 0 and (tokens[stop].upper in ENDS or tokens[stop].text in (",", ")"))):
            depth += (tokens[stop].text == "(") - (tokens[stop].text == ")")
            stop += 1
        sides = [significant(tokens[begin + 1 : at]), significant(tokens[join + 1 : on])]
        if not all(s and s[-1].is_name and find(s, ",") < 0 and find(s, "JOIN") < 0 for s in sides) or self._joins_more(tokens[stop:]):
            return tokens
        left, right = (s[-1].name for s in sides)
        keys = self._equalities(tokens[on + 1 : stop], right)
        if not keys or any(len(x) != 2 or x[0].lower() != left.lower() for x, _ in keys):
            return tokens
        rest = significant([*tokens[:begin], *tokens[stop:]])
        if any(t.is_name and t.name.lower() in (left.lower(), right.lower()) and not (i + 1 < len(rest) and rest[i + 1].text == ".") for i, t in enumerate(rest)):
            return tokens
        texts = [self.query(s) for s in (tokens[begin + 1 : at], tokens[join + 1 : on])]
        view = self.scope.full_view(f"SELECT * FROM {texts[0]}", f"SELECT * FROM {texts[1]}", (left, right), [(x[1], y) for x, y in keys])
        if view is None:
            return tokens
        self.used_bins = True
        return [*tokens[: begin + 1], raw(f" `{view}` "), *tokens[stop:]]

    def _without(self, head: list[Token], hidden: dict[str | None, list[str]]) -> list[Token]:
        """The start of a query, its stars without the hidden columns."""
        out, stars = [], set(self._stars(head))
        for i, t in enumerate(head):
            out.append(t)
            j = before(head, i)
            if i in stars and (columns := hidden.get(head[before(head, j)].name.lower() if head[j].text == "." else None)):
                out.append(raw(f" EXCEPT ({', '.join(f'`{c}`' for c in columns)})"))
        return out

    @staticmethod
    def _bounds(condition: list[Token], left: str, right: str) -> dict[tuple[str, str, bool], tuple[float | None, float | None]]:
        """Of pairs of columns (left, right, whether a number is added to one): the least and the most that the right one is above the left, by the conjuncts of a condition; of times in seconds."""

        def term(words: list[Token]) -> tuple[str, str, float, bool | None] | None:
            if len(words) not in (3, 5, 7) or not (words[0].is_name and words[1].text == "." and words[2].is_name):
                return None
            if len(words) == 3:
                return words[0].name.lower(), words[2].name, 0, None
            sign = 1 if words[3].text == "+" else -1
            if words[3].text not in "+-":
                return None
            if len(words) == 5:
                plain = words[4].kind == "number" and words[4].text.replace(".", "", 1).isdigit()
                return (words[0].name.lower(), words[2].name, sign * float(words[4].text), True) if plain else None
            word, number, unit = words[4:]
            amount = number.text.strip("'")
            if word.upper != "INTERVAL" or not amount.isdigit() or unit.upper.rstrip("S") not in UNITS or unit.upper.rstrip("S") in ("MONTH", "YEAR"):
                return None
            return words[0].name.lower(), words[2].name, sign * int(amount) * UNITS[unit.upper.rstrip("S")], False

        bounds: list[tuple[str, str, str, float, bool | None]] = []

        def add(x: list[Token], op: str, y: list[Token]) -> None:
            a, b = term(x), term(y)
            if a is None or b is None or {a[0], b[0]} != {left, right} or {a[3], b[3]} >= {True, False}:
                return
            if a[0] == left:
                a, b, op = b, a, {"<": ">", ">": "<"}.get(op[0], op[0])
            # right + a <op> left + b
            bounds.append((b[1], a[1], op[0], b[2] - a[2], b[3] if a[3] is None else a[3]))

        parts, i = split(significant(condition), "AND"), 0
        while i < len(parts):
            part = parts[i]
            between = find(part, "BETWEEN")
            if between >= 0 and i + 1 < len(parts):
                if find(part, "NOT") < 0:
                    add(part[:between], ">=", part[between + 1 :])
                    add(part[:between], "<=", parts[i + 1])
                i += 1
            elif find(part, "OR") < 0:
                for k, t in enumerate(part):
                    if t.text in ("<", ">", "<=", ">="):
                        add(part[:k], t.text, part[k + 1 :])
            i += 1
        found: dict[tuple[str, str, bool], tuple[float | None, float | None]] = {}
        for ours, theirs, op, apart, kind in bounds:
            # a bare comparison is one of numbers if another one of the pair is
            numeric = kind if kind is not None else any(k for x, y, _, _, k in bounds if (x, y) == (ours, theirs))
            low, high = found.get((ours, theirs, numeric), (None, None))
            if op == ">":
                low = apart if low is None else max(low, apart)
            else:
                high = apart if high is None else min(high, apart)
            found[ours, theirs, numeric] = low, high
        return found

    @staticmethod
    def _stars(head: list[Token]) -> list[int]:
        """Places of the stars of a query's own list, from its start up to FROM."""
        out, depth = [], 0
        for i, t in enumerate(head):
            depth += (t.text == "(") - (t.text == ")")
            j, k = before(head, i), after(head, i + 1)
            if t.text == "*" and depth == 0 and j >= 0 and (k >= len(head) or head[k].upper in (",", "FROM")) and head[j].upper in ("SELECT", ",", "."):
                out.append(i)
        return out

    def _starred(self, head: list[Token]) -> bool:
        return any(head[before(head, i)].text != "." for i in self._stars(head))

    @staticmethod
    def _joins_more(rest: list[Token]) -> bool:
        end = min([i for w in ("WHERE", "GROUP", "HAVING", "ORDER", "UNION", "LIMIT") if (i := find(rest, w)) >= 0], default=len(rest))
        return find(rest[:end], "JOIN") >= 0 or find(rest[:end], ",") >= 0

    def _expanded(self, head: list[Token], left: str, version: str) -> tuple[list[Token], bool]:
        """The start of a query whose version is a struct column of the left table; and whether a bare star asks for all columns."""
        out, stars, bare = [], set(self._stars(head)), False
        for i, t in enumerate(head):
            j = before(head, i)
            if i not in stars:
                out.append(t)
            elif head[j].text != ".":
                bare = True
                out.append(raw(f"`{left}`.* EXCEPT (`{version}`), `{version}`.*"))
            elif head[before(head, j)].name.lower() == left.lower():
                out.append(raw(f"* EXCEPT (`{version}`)"))
            else:
                out.append(t)
        return out, bare

    @staticmethod
    def _equalities(condition: list[Token], alias: str) -> list[tuple[tuple[str, ...], str]] | None:
        """(left path, right column) of a conjunction of equalities with ``alias``; None for any other condition."""
        out = []
        for part in split(significant(condition), "AND"):
            eq = find(part, "=")
            if eq < 0:
                return None
            sides = [[t.name for t in x if t.is_name] for x in (part[:eq], part[eq + 1 :])]
            if len(part) != sum(2 * len(s) - 1 for s in sides) + 1:
                return None
            if sides[0][0].lower() == alias.lower() and len(sides[0]) == 2:
                sides.reverse()
            if sides[1][0].lower() != alias.lower() or len(sides[1]) != 2:
                return None
            out.append((tuple(sides[0]), sides[1][1]))
        return out

    @staticmethod
    def _mentioned(condition: list[Token], alias: str) -> list[tuple[tuple[str, ...], str]]:
        words = significant(condition)
        return [((), words[i + 2].name) for i in range(len(words) - 2) if words[i].is_name and words[i].name.lower() == alias.lower() and words[i + 1].text == "." and not (i and words[i - 1].text == ".")]

    def _plain_left(self, tokens: list[Token], right: int) -> tuple[str, str, str, int] | None:
        """(table, alias, how, place) if ``FROM table [alias] [LEFT|INNER] JOIN`` stands before ``right``."""
        j = before(tokens, right)
        if j < 0 or tokens[j].upper != "JOIN":
            return None
        how, j = "inner", before(tokens, j)
        if tokens[j].upper == "OUTER":
            j = before(tokens, j)
        if tokens[j].upper in ("LEFT", "INNER"):
            how, j = tokens[j].upper.lower(), before(tokens, j)
        elif tokens[j].upper in ("RIGHT", "FULL", "CROSS"):
            return None
        if not tokens[j].is_name:
            return None
        alias, k = tokens[j].name, before(tokens, j)
        if tokens[k].upper == "AS":
            k = before(tokens, k)
        if tokens[k].upper == "FROM":
            return alias, alias, how, j
        if tokens[k].is_name and tokens[before(tokens, k)].upper == "FROM":
            return tokens[k].name, alias, how, k
        return None


def windowed(kind: str, source: str, ts: str, spans: list[str], partition: list[str] = ()) -> str:
    """SQL: rows of ``source`` with window_start, window_end and window_time (a millisecond before the end)."""
    w = "`_w`"
    ends = f"{w}.start AS window_start, {w}.end AS window_end, {w}.end - INTERVAL '0.001' SECOND AS window_time"
    offset = f", '{spans[-1]}'" if (kind == "TUMBLE" and len(spans) > 1) or (kind == "HOP" and len(spans) > 2) else ""
    if kind == "TUMBLE":
        size = f"'{spans[0]}'" + (f", '{spans[0]}'{offset}" if offset else "")
        return f"(SELECT * EXCEPT ({w}), {ends} FROM (SELECT *, window({ts}, {size}) AS {w} FROM {source}))"
    if kind == "HOP":
        return f"(SELECT * EXCEPT ({w}), {ends} FROM (SELECT *, window({ts}, '{spans[1]}', '{spans[0]}'{offset}) AS {w} FROM {source}))"
    if kind == "CUMULATE":
        step = f"INTERVAL {spans[0]}"
        made = f"explode(filter(sequence({w}.start + {step}, {w}.end, {step}), e -> e > {ts}))"
        return f"(SELECT * EXCEPT ({w}, `_e`), {w}.start AS window_start, `_e` AS window_end, `_e` - INTERVAL '0.001' SECOND AS window_time FROM (SELECT *, {made} AS `_e` FROM (SELECT *, window({ts}, '{spans[1]}') AS {w} FROM {source})))"
    gap, by = f"INTERVAL {spans[0]}", "".join(f"{p}, " for p in partition)
    over = f"PARTITION BY {by[:-2]} " if partition else ""
    inner = f"SELECT *, CAST(coalesce({ts} > lag({ts}) OVER ({over}ORDER BY {ts}) + {gap}, true) AS BIGINT) AS `_new` FROM {source}"
    numbered = f"SELECT *, sum(`_new`) OVER ({over}ORDER BY {ts}) AS `_s` FROM ({inner})"
    last = f"max({ts}) OVER (PARTITION BY {by}`_s`) + {gap}"
    return f"(SELECT * EXCEPT (`_new`, `_s`), min({ts}) OVER (PARTITION BY {by}`_s`) AS window_start, {last} AS window_end, {last} - INTERVAL '0.001' SECOND AS window_time FROM ({numbered}))"

