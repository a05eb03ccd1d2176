"""Type and primary key of a query, read off Spark's own analyzed plan.

Catalyst has resolved names and given each attribute an id, so the pass only follows ids
from leaf to root. A primary key is a list of sets of ids: the ids of a set hold the same value, and
one of each set makes the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from .table_type import JOIN_COST, UNBOUND_FACTOR, TableType, combine, of_union

Key = list[frozenset[int]]


@dataclass
class Known:
    """What is known of a table by name."""

    type: TableType
    primary_key: list[str] | None
    rowtime: str | None = None


@dataclass
class Analysis:
    """``key`` None: not known; an empty list: at most one row."""

    type: TableType
    key: Key | None = None
    times: frozenset[int] = frozenset()
    join_cost: float = 1.0
    notices: list[str] = field(default_factory=list)
    sources: set[str] = field(default_factory=set)
    #: ids of ROW_NUMBER columns, with the partition and whether it is ordered by one time, latest first
    ranks: dict[int, tuple[list[int], bool]] = field(default_factory=dict)
    #: ids of window_start and window_end columns
    windows: frozenset[int] = frozenset()


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _id(x) -> int:
    return x.exprId().id()


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _references(x) -> set[int]:
    it = x.references().iterator()
    out = set()
    while it.hasNext():
        out.add(_id(it.next()))
    return out


def _conjuncts(x) -> Iterator:
    if _name(x) == "And":
        yield from _conjuncts(x.left())
        yield from _conjuncts(x.right())
    else:
        yield x


def _plain(x):
    """An attribute under casts, aliases and metadata markers; None for anything else."""
    while _name(x) in ("Cast", "Alias", "TempResolvedColumn", "PreciseTimestampConversion", "KnownNotNull"):
        x = x.child()
    return x if _name(x) == "AttributeReference" else None


class Analyzer:
    def __init__(self, known: Callable[[str], Known | None]):
        self.known = known

    def analyze(self, df: DataFrame) -> tuple[Analysis, list[str] | None, str | None]:
        """The analysis of a frame, with its key and its single rowtime as column names."""
        plan = df._jdf.queryExecution().analyzed()
        a = self.visit(plan)
        output = [(_id(x), x.name()) for x in _seq(plan.output())]
        key = None
        if a.key is not None:
            key = []
            for ids in a.key:
                name = next((n for i, n in output if i in ids), None)
                if name is None:
                    key = None
                    break
                key.append(name)
        times = [n for i, n in output if i in a.times]
        if len(times) > 1:
            a.notices.append(f"more than one rowtime column: {', '.join(times)}")
        return a, key, times[0] if times else None

    def visit(self, node) -> Analysis:
        return getattr(self, f"_{_name(node).lower()}", self._other)(node)

    def _one(self, node) -> Analysis:
        return self.visit(node.child())

    def _other(self, node) -> Analysis:
        """Pass-through of one child (sorts, limits, hints, watermarks); leaves are relations."""
        children = _seq(node.children())
        if len(children) == 1:
            return self.visit(children[0])
        if not children:
            return Analysis(TableType.RELATION)
        return self._joined([self.visit(c) for c in children])

    @staticmethod
    def _joined(parts: list[Analysis]) -> Analysis:
        kind = parts[0].type
        for p in parts[1:]:
            kind = combine(kind, p.type)
        return Analysis(kind, None, sources=set().union(*[p.sources for p in parts]))

    def _subqueryalias(self, node) -> Analysis:
        found = self.known(node.identifier().name())
        if found is None:
            return self._one(node)
        ids = {x.name().lower(): _id(x) for x in _seq(node.output())}
        key = None if found.primary_key is None else [frozenset([ids[c.lower()]]) for c in found.primary_key if c.lower() in ids]
        if found.primary_key is not None and len(key) < len(found.primary_key):
            key = None
        times = frozenset([ids[found.rowtime.lower()]]) if found.rowtime and found.rowtime.lower() in ids else frozenset()
        windows = frozenset(ids[n] for n in ("window_start", "window_end") if n in ids)
        return Analysis(found.type, key, times, sources={node.identifier().name()}, windows=windows)

    def _localrelation(self, node) -> Analysis:
        output = _seq(node.output())
        return Analysis(TableType.STATIC, [] if node.data().size() <= 1 else [frozenset([_id(output[0])])] if output else None)

    def _onerowrelation(self, node) -> Analysis:
        return Analysis(TableType.STATIC, [])

    def _range(self, node) -> Analysis:
        return Analysis(TableType.STATIC, [frozenset([_id(_seq(node.output())[0])])])

    def _generate(self, node) -> Analysis:
        a = self._one(node)
        return replace(a, key=None)

    def _filter(self, node) -> Analysis:
        a = self._one(node)
        fixed: set[int] = set()
        out = a
        for c in _conjuncts(node.condition()):
            if _name(c) not in ("EqualTo", "EqualNullSafe"):
                continue
            sides = [c.left(), c.right()]
            for x, y in (sides, sides[::-1]):
                attribute = _plain(x)
                if attribute is not None and not _references(y):
                    fixed.add(_id(attribute))
                    if _id(attribute) in a.ranks:
                        partition, latest = a.ranks[_id(attribute)]
                        kind = TableType.VERSIONED_STATE if a.type is TableType.STREAM and latest else TableType.STATE if a.type is not TableType.STREAM else TableType.VERSIONED_STATE
                        out = replace(out, type=kind, key=[frozenset([i]) for i in partition])
        if out.key is not None:
            out = replace(out, key=[ids for ids in out.key if not ids & fixed])
        return out

    def _project(self, node) -> Analysis:
        a = self._one(node)
        return self._renamed(a, _seq(node.projectList()))

    @staticmethod
    def _renamed(a: Analysis, expressions: list) -> Analysis:
        to: dict[int, set[int]] = {}
        for x in expressions:
            source = _plain(x)
            if source is not None:
                to.setdefault(_id(source), set()).add(_id(x))
        starts = set()
        for x in expressions:
            if _name(x) == "Alias" and x.name() in ("window_start", "window_end"):
                starts.add(_id(x))
        key = None
        if a.key is not None:
            key = [frozenset().union(*[to.get(i, set()) for i in ids]) for ids in a.key]
            key = key if all(key) else None
        moved = lambda ids: frozenset().union(*[to.get(i, set()) for i in ids]) if ids else frozenset()
        ranks = {n: v for i, v in a.ranks.items() for n in to.get(i, ())}
        return replace(a, key=key, times=moved(a.times), ranks=ranks, windows=moved(a.windows) | frozenset(starts))

    def _window(self, node) -> Analysis:
        a = self._one(node)
        partition = [_plain(x) for x in _seq(node.partitionSpec())]
        order = _seq(node.orderSpec())
        ranks = dict(a.ranks)
        if all(p is not None for p in partition):
            first = _plain(order[0].child()) if order else None
            latest = bool(first is not None and _id(first) in a.times and "DESC" in order[0].toString().upper())
            for x in _seq(node.windowExpressions()):
                if "row_number()" in x.toString().lower():
                    ranks[_id(x)] = ([_id(p) for p in partition], latest)
        return replace(a, ranks=ranks)

    def _join(self, node) -> Analysis:
        left, right = self.visit(node.left()), self.visit(node.right())
        how = node.joinType().sql().upper()
        if "SEMI" in how or "ANTI" in how:
            return replace(left, sources=left.sources | right.sources)
        ids = [{_id(x) for x in _seq(s.output())} for s in (node.left(), node.right())]
        pairs: list[tuple[int, int]] = []
        fixed: set[int] = set()
        bounded = False
        condition = node.condition()
        if condition.isDefined():
            for c in _conjuncts(condition.get()):
                refs = _references(c)
                bounded |= bool(refs & left.times) and bool(refs & right.times)
                if _name(c) in ("EqualTo", "EqualNullSafe"):
                    x, y = _plain(c.left()), _plain(c.right())
                    if x is not None and y is not None:
                        i, j = (_id(x), _id(y)) if _id(x) in ids[0] else (_id(y), _id(x))
                        if i in ids[0] and j in ids[1]:
                            pairs.append((i, j))
                    elif (x is None) != (y is None) and len(refs) == 1:
                        fixed |= refs
        same = dict(pairs)
        back = {j: i for i, j in pairs}
        unique = lambda key, used: key is not None and all(k & used for k in key)
        left_unique, right_unique = unique(left.key, set(same)), unique(right.key, set(back))
        key: Key | None = None
        if left.key is not None and right.key is not None:
            key = [k | frozenset(same[i] for i in k if i in same) for k in left.key]
            for k in right.key:
                if right_unique:
                    break  # the left row determines the right one
                if not any(back.get(i) in m for m in left.key for i in k):
                    key.append(k | frozenset(back[i] for i in k if i in back))
            if left_unique and not right_unique:
                key = [k | frozenset(back[i] for i in k if i in back) for k in right.key]
            key = [k for k in key if not k & fixed]
        elif right_unique and left.key is not None:
            key = left.key
        streams = left.type is right.type is TableType.STREAM
        outer = "OUTER" in how
        notices = [*left.notices, *right.notices]
        if streams and bounded:
            kind = TableType.STREAM
        elif streams:
            kind = TableType.STATE if outer else TableType.STREAM
        else:
            kind = combine(left.type, right.type)
            for s, v, v_ids in ((left, right, set(back)), (right, left, set(same))):
                if s.type is TableType.STREAM and v.type.supports_temporal_join and unique(v.key, v_ids):
                    notices.append("a stream is joined with a versioned table on its whole key: a temporal join (FOR SYSTEM_TIME AS OF) would keep it a stream")
        cost = 1.0
        for s, u in ((left, left_unique), (right, right_unique)):
            cost *= 1.0 if u else JOIN_COST[s.type] ** 0.5
        if not pairs and not (left_unique or right_unique):
            cost *= UNBOUND_FACTOR
        times = left.times | right.times if kind is TableType.STREAM else frozenset()
        return Analysis(kind, key, times, left.join_cost * right.join_cost * cost, notices, left.sources | right.sources, {**left.ranks, **right.ranks}, left.windows | right.windows)

    def _lateraljoin(self, node) -> Analysis:
        left, right = self.visit(node.left()), self.visit(node.right().plan())
        key = [*left.key, *right.key] if left.key is not None and right.key is not None else None
        return replace(left, key=key, sources=left.sources | right.sources)

    def _aggregate(self, node) -> Analysis:
        a = self._one(node)
        outputs = _seq(node.aggregateExpressions())
        grouped = [_plain(g) for g in _seq(node.groupingExpressions())]
        texts = [g.canonicalized().toString() for g in _seq(node.groupingExpressions())]
        key: Key | None = []
        for g, text in zip(grouped, texts, strict=True):
            ids = frozenset(_id(x) for x in outputs if (g is not None and (p := _plain(x)) is not None and _id(p) == _id(g)) or (_name(x) == "Alias" and x.child().canonicalized().toString() == text))
            if not ids:
                key = None
                break
            key.append(ids)
        moved = self._renamed(a, outputs)
        by_window = len({_id(g) for g in grouped if g is not None} & a.windows) >= 2
        kind = TableType.STREAM if a.type is TableType.STREAM and by_window else TableType.STATE if a.type is not TableType.STATIC else TableType.STATIC
        return replace(moved, type=kind, key=key, times=frozenset(), ranks={})

    def _distinct(self, node) -> Analysis:
        a = self._one(node)
        return replace(a, type=TableType.STATE if a.type is not TableType.STATIC else a.type, key=[frozenset([_id(x)]) for x in _seq(node.output())])

    def _union(self, node) -> Analysis:
        parts = [self.visit(c) for c in _seq(node.children())]
        output = [_id(x) for x in _seq(node.output())]
        places = []
        for c, p in zip(_seq(node.children()), parts, strict=True):
            at = {_id(x): i for i, x in enumerate(_seq(c.output()))}
            places.append(None if p.key is None else {min((at[i] for i in k if i in at), default=-1) for k in p.key})
        key = [frozenset([output[i]]) for i in sorted(places[0])] if places[0] is not None and all(p == places[0] for p in places) and -1 not in places[0] else None
        kind = of_union([p.type for p in parts], True)
        firsts = [{_seq(c.output()).index(x) for x in _seq(c.output()) if _id(x) in p.times} for c, p in zip(_seq(node.children()), parts, strict=True)]
        times = frozenset(output[i] for i in set.intersection(*firsts)) if kind is TableType.STREAM else frozenset()
        return Analysis(kind, key, times, sources=set().union(*[p.sources for p in parts]))

    def _setoperation(self, node) -> Analysis:
        parts = [self.visit(node.left()), self.visit(node.right())]
        return Analysis(of_union([p.type for p in parts], False), parts[0].key, sources=parts[0].sources | parts[1].sources)

    _except = _intersect = _setoperation
