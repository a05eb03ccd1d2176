"""Scripts as lists of typed statements."""

from __future__ import annotations

from dataclasses import dataclass, field

from .hints import Hints, parse_hints
from .tokens import ScriptError, Token, after, closing, find, lex, significant, split, sql


@dataclass
class Argument:
    """Of a function: a name, a type, and where its value comes from if the caller doesn't give it."""

    name: str
    type: str
    nullable: bool = True
    computed: str | None = None
    metadata: str | None = None


@dataclass
class Column:
    """Of a declared table."""

    name: str
    type: str | None
    nullable: bool = True
    computed: str | None = None
    metadata: str | None = None


@dataclass
class Statement:
    line: int = 0
    doc: str = ""
    hints: Hints = field(default_factory=Hints)


@dataclass
class Import(Statement):
    path: tuple[str, ...] = ()
    alias: str | None = None


@dataclass
class Export(Statement):
    table: tuple[str, ...] = ()
    target: tuple[str, ...] = ()


@dataclass
class CreateTable(Statement):
    name: str = ""
    columns: list[Column] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    partitioned_by: list[str] = field(default_factory=list)
    watermark: tuple[str, str] | None = None
    options: dict[str, str] = field(default_factory=dict)
    like: str | None = None


@dataclass
class Definition(Statement):
    """``name`` is (table,) or (parent, relationship)."""

    name: tuple[str, ...] = ()
    arguments: list[Argument] | None = None
    returns: list[Column] | None = None
    body: list[Token] = field(default_factory=list)
    subscribe: bool = False


@dataclass
class Distinct(Statement):
    name: str = ""
    source: str = ""
    keys: list[str] = field(default_factory=list)
    order: list[tuple[str, bool, bool | None]] = field(default_factory=list)  # column, descending, nulls last


@dataclass
class AddColumn(Statement):
    table: str = ""
    column: str = ""
    expression: list[Token] = field(default_factory=list)


@dataclass
class Insert(Statement):
    table: str = ""
    columns: list[str] = field(default_factory=list)
    body: list[Token] = field(default_factory=list)


@dataclass
class NextBatch(Statement):
    pass


@dataclass
class CreateFunction(Statement):
    name: str = ""
    target: str = ""


@dataclass
class Passed(Statement):
    """A statement that Spark SQL takes as it is."""

    body: list[Token] = field(default_factory=list)


def parse_script(text: str) -> list[Statement]:
    out = []
    for tokens in split(lex(text), ";"):
        if significant(tokens):
            out.append(parse_statement(tokens))
    return out


def parse_statement(tokens: list[Token]) -> Statement:
    doc, hints, line = "", Hints(), significant(tokens)[0].line
    for t in tokens:
        if t.kind == "doc":
            doc = "\n".join(x.strip().lstrip("*").strip() for x in t.text[3:-2].splitlines()).strip()
        elif t.kind == "hint" and t.line <= line:
            found = parse_hints(t.text, t.line)
            for name, args in found.by_name.items():
                hints.by_name.setdefault(name, []).extend(args)
            hints.unknown += found.unknown
        elif t.kind not in ("space", "comment", "hint", "doc"):
            break
    own = [t for t in tokens if t.kind not in ("doc", "hint", "comment")]
    out = _parse(own[after(own, 0) :], line)
    out.line, out.doc, out.hints = line, doc, hints
    return out


def _parse(tokens: list[Token], line: int) -> Statement:
    words = significant(tokens)
    first = words[0].upper
    if find(tokens, ":=") >= 0:
        return _definition(tokens, line)
    if first == "IMPORT":
        return _import(words, line)
    if first == "EXPORT":
        to = next((i for i, t in enumerate(words) if t.upper == "TO"), 0)
        if not to or to + 1 >= len(words):
            raise ScriptError("EXPORT needs TO and a target", line)
        return Export(table=_path(words[1:to], line), target=_path(words[to + 1 :], line))
    if first == "NEXT_BATCH":
        return NextBatch()
    if first in ("ALTER", "DROP"):
        raise ScriptError(f"{first} is not supported", line)
    if first == "CREATE":
        kinds = [t.upper for t in words[1:4]]
        if "CATALOG" in kinds[:1]:
            raise ScriptError("CREATE CATALOG is not supported", line)
        if "FUNCTION" in kinds:
            return _create_function(words, line)
        if "TABLE" in kinds[:2]:
            return _create_table(tokens, line)
        if "VIEW" in kinds[:2]:
            return _create_view(tokens, line)
    if first == "INSERT":
        return _insert(tokens, line)
    if first in ("USE", "CREATE", "SET"):
        return Passed(body=tokens)
    raise ScriptError(f"not a statement: {sql(tokens)[:60]}", line)


def _path(words: list[Token], line: int) -> tuple[str, ...]:
    names = words[::2]
    if not words or len(words) % 2 == 0 or any(t.text != "." for t in words[1::2]) or not all(t.is_name or t.text == "*" for t in names):
        raise ScriptError(f"not a path: {' '.join(t.text for t in words)}", line)
    return tuple(t.name for t in names)


def _import(words: list[Token], line: int) -> Import:
    alias = None
    if len(words) > 3 and words[-2].upper == "AS":
        alias, words = words[-1].name, words[:-2]
    # names may hold hyphens: a-b.c
    path, part = [], ""
    for t in words[1:]:
        if t.text == ".":
            path.append(part)
            part = ""
        else:
            part += t.name
    path.append(part)
    if not all(path):
        raise ScriptError("IMPORT needs a path", line)
    return Import(path=tuple(path), alias=alias)


def arguments(tokens: list[Token], line: int) -> list[Argument]:
    columns = [_column(part, line) for part in _declarations(tokens)]
    return [Argument(c.name, c.type or "STRING", c.nullable, c.computed, c.metadata) for c in columns]


def _declarations(tokens: list[Token]) -> list[list[Token]]:
    """Parts between commas outside of brackets, those of types (``ARRAY<..>``) included."""
    parts, depth, angles, last = [[]], 0, 0, ""
    for t in tokens:
        if t.kind == "op":
            depth += (t.text in "([") - (t.text in ")]")
            angles += t.text == "<" and (angles > 0 or last in ("ARRAY", "MAP", "ROW", "MULTISET"))
            angles -= t.text == ">" and angles > 0
        if depth == 0 and angles == 0 and t.text == ",":
            parts.append([])
        else:
            parts[-1].append(t)
        last = last if t.kind == "space" else t.upper
    return parts if significant(tokens) else []


def _column(tokens: list[Token], line: int) -> Column:
    words = significant(tokens)
    if len(words) < 2 or not words[0].is_name:
        raise ScriptError(f"not a column: {sql(tokens)}", line)
    name = words[0].name
    at = next(i for i, t in enumerate(tokens) if t is words[0])
    rest = tokens[at + 1 :]
    if words[1].upper == "AS":
        return Column(name, None, True, computed=sql(rest[after(rest, 0) + 1 :]))
    metadata, nullable = None, True
    cut = find(rest, "METADATA")
    if cut >= 0:
        source = [t for t in rest[cut:] if t.kind == "string"]
        metadata = source[0].text[1:-1] if source else name
        rest = rest[:cut]
    as_ = find(rest, "AS")
    computed = None
    if as_ >= 0:
        computed, rest = sql(rest[as_ + 1 :]), rest[:as_]
    not_null = find(rest, "NOT", "NULL")
    if not_null >= 0:
        nullable, rest = False, rest[:not_null]
    for word in ("PRIMARY", "COMMENT", "NULL"):
        i = find(rest, word)
        rest = rest[:i] if i >= 0 else rest
    return Column(name, spark_type(rest), nullable, computed, metadata)


def spark_type(tokens: list[Token]) -> str:
    """A declared type in Spark's words."""
    words = significant(tokens)
    if not words:
        return "STRING"
    head = words[0].upper
    last = words[-1].upper
    if last == "ARRAY" and len(words) > 1:
        return f"ARRAY<{spark_type(words[:-1])}>"
    if head in ("ARRAY", "MULTISET", "MAP") and len(words) > 1 and words[1].text == "<":
        inner = [spark_type(x) for x in _declarations(words[2:-1])]
        return f"{'MAP' if head == 'MAP' else 'ARRAY'}<{', '.join(inner)}>"
    if head == "ROW":
        inner = words[2:-1]
        parts = _declarations(inner)
        return "STRUCT<" + ", ".join(f"`{p[0].name}`: {spark_type([t for t in p[1:] if t.upper not in ('NOT', 'NULL')])}" for p in parts) + ">"
    text = sql(words).upper().replace(" ", "")
    args = text[text.find("(") :] if "(" in text else ""
    if head in ("TIMESTAMP_LTZ",) or (head == "TIMESTAMP" and "LOCAL" in text):
        return "TIMESTAMP"
    if head == "TIMESTAMP":
        return "TIMESTAMP_NTZ"
    if head in ("VARCHAR", "CHAR", "STRING"):
        return "STRING"
    if head in ("BYTES", "BINARY", "VARBINARY"):
        return "BINARY"
    if head in ("DECIMAL", "NUMERIC", "DEC"):
        return f"DECIMAL{args or '(10,0)'}"
    if head == "INTEGER":
        return "INT"
    if head == "JSONB":
        return "VARIANT"
    if head == "VECTOR":
        return "ARRAY<DOUBLE>"
    if head in ("DOUBLE", "FLOAT", "BOOLEAN", "TINYINT", "SMALLINT", "INT", "BIGINT", "DATE", "TIME", "VARIANT"):
        return head
    return sql(words)


def _create_table(tokens: list[Token], line: int) -> CreateTable:
    opened = find(tokens, "(")
    opened = next((i for i, t in enumerate(tokens) if t.text == "("), -1) if opened < 0 else opened
    with_ = find(tokens, "WITH")
    head = significant(tokens[: opened if opened >= 0 and (with_ < 0 or opened < with_) else len(tokens)])
    at = next(i for i, t in enumerate(head) if t.upper == "TABLE") + 1
    if [t.upper for t in head[at : at + 3]] == ["IF", "NOT", "EXISTS"]:
        at += 3
    out = CreateTable(name=head[at].name)
    rest = tokens
    if opened >= 0 and (with_ < 0 or opened < with_):
        end = closing(tokens, opened)
        for part in _declarations(tokens[opened + 1 : end]):
            words = significant(part)
            if not words:
                continue
            kind = words[0].upper
            if kind == "PRIMARY" or kind == "CONSTRAINT":
                i = next(i for i, t in enumerate(words) if t.text == "(")
                out.primary_key = [t.name for t in words[i + 1 : closing(words, i)] if t.is_name]
            elif kind == "WATERMARK":
                as_ = find(part, "AS")
                out.watermark = (words[2].name, sql(part[as_ + 1 :]))
            else:
                column = _column(part, line)
                if any(c.name == column.name for c in out.columns):
                    raise ScriptError(f"column {column.name} is declared twice", line)
                out.columns.append(column)
                if any(t.upper == "PRIMARY" for t in words):
                    out.primary_key = [words[0].name]
        rest = tokens[end + 1 :]
    by = find(rest, "PARTITIONED", "BY")
    if by >= 0:
        i = next(i for i in range(by, len(rest)) if rest[i].text == "(")
        out.partitioned_by = [t.name for t in rest[i : closing(rest, i)] if t.is_name]
    with_ = find(rest, "WITH")
    if with_ >= 0:
        i = next(i for i in range(with_, len(rest)) if rest[i].text == "(")
        for part in split(rest[i + 1 : closing(rest, i)]):
            words = significant(part)
            if words:
                out.options[words[0].text.strip("'")] = words[2].text[1:-1] if words[2].kind == "string" else words[2].text
    like = find(rest, "LIKE")
    if like >= 0:
        out.like = sql([t for t in rest[like + 1 :] if t.kind != "space"]).split("(")[0].strip("`'")
    return out


def _create_view(tokens: list[Token], line: int) -> Definition:
    as_ = find(tokens, "AS")
    words = significant(tokens[:as_])
    return Definition(name=(words[-1].name,), body=tokens[as_ + 1 :])


def _create_function(words: list[Token], line: int) -> CreateFunction:
    as_ = next((i for i, t in enumerate(words) if t.upper == "AS"), 0)
    if not as_:
        raise ScriptError("CREATE FUNCTION needs AS", line)
    return CreateFunction(name=words[as_ - 1].name, target=words[as_ + 1].text[1:-1])


def _insert(tokens: list[Token], line: int) -> Insert:
    words = significant(tokens)
    at = next((i for i, t in enumerate(words) if t.upper == "INTO"), 0)
    if not at:
        raise ScriptError("INSERT needs INTO", line)
    name = words[at + 1]
    rest = tokens[next(i for i, t in enumerate(tokens) if t is name) + 1 :]
    columns, i = [], after(rest, 0)
    if rest[i].text == "(" and rest[after(rest, i + 1)].upper not in ("SELECT", "WITH", "VALUES"):
        end = closing(rest, i)
        columns, rest = [t.name for t in rest[i:end] if t.is_name], rest[end + 1 :]
    return Insert(table=name.name, columns=columns, body=rest)


def _definition(tokens: list[Token], line: int) -> Statement:
    mark = find(tokens, ":=")
    head, body = tokens[:mark], tokens[mark + 1 :]
    if not significant(body):
        raise ScriptError("nothing is defined after :=", line)
    returns = None
    ret = find(head, "RETURNS")
    if ret >= 0:
        i = next((i for i in range(ret, len(head)) if head[i].text == "("), -1)
        if i < 0:
            raise ScriptError("RETURNS needs columns", line)
        returns, head = [_column(p, line) for p in _declarations(head[i + 1 : closing(head, i)])], head[:ret]
    args = None
    i = next((i for i, t in enumerate(head) if t.text == "("), -1)
    if i >= 0:
        args, head = arguments(head[i + 1 : closing(head, i)], line), head[:i]
    name = _path(significant(head), line)
    if len(name) > 2:
        raise ScriptError(f"a name has at most two parts: {'.'.join(name)}", line)
    words = significant(body)
    first = words[0].upper
    if first == "DISTINCT" and args is None:
        return _distinct(name, words, line)
    subscribe = first == "SUBSCRIBE"
    if subscribe:
        if len(name) > 1:
            raise ScriptError("a relationship cannot be a subscription", line)
        body = body[find(body, "SUBSCRIBE") + 1 :]
        first = significant(body)[0].upper
    if first not in ("SELECT", "WITH", "(", "VALUES", "FROM", "TABLE") and returns is None:
        if len(name) == 2 and args is None:
            return AddColumn(table=name[0], column=name[1], expression=body)
        raise ScriptError("a definition needs SELECT, WITH or DISTINCT", line)
    return Definition(name=name, arguments=args, returns=returns, body=body, subscribe=subscribe)


def _distinct(name: tuple[str, ...], words: list[Token], line: int) -> Distinct:
    if len(name) != 1:
        raise ScriptError("DISTINCT defines a table", line)
    on = next((i for i, t in enumerate(words) if t.upper == "ON"), 0)
    order = next((i for i, t in enumerate(words) if t.upper == "ORDER"), 0)
    if on < 2 or order <= on or words[order + 1].upper != "BY":
        raise ScriptError("DISTINCT needs a source, ON and ORDER BY", line)
    out = Distinct(name=name[0], source=".".join(_path(words[1:on], line)))
    out.keys = [p[-1].name for p in split(words[on + 1 : order])]
    for part in split(words[order + 2 :]):
        said = [t.upper for t in part[1:]]
        if not part[0].is_name or any(x not in ("ASC", "DESC", "NULLS", "FIRST", "LAST") for x in said):
            raise ScriptError(f"DISTINCT cannot order by {' '.join(t.text for t in part)}", line)
        last = True if "LAST" in said else False if "FIRST" in said else None
        out.order.append((part[0].name, "DESC" in said, last))
    if not out.keys or not out.order:
        raise ScriptError("DISTINCT needs keys and an order", line)
    return out
