"""Scripts on a Spark session: definitions become lazy frames, queries and exports run them."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import python as python_functions
from ..operators.dedup import Order, distinct_on, filtered_distinct, ordering, updates
from ..operators.joins import asof_join, full_join, versions
from ..operators.paging import PAGE_SIZE, Page, page
from ..operators.upsert import expired
from ..sources.connectors import SINKS, Connector
from ..sources.discovery import discover, files_format
from ..sources.scratch import scratch
from .analysis import Analysis, Analyzer, Known
from .cost import Node, stage
from .hints import Hints
from .rewrite import Rewriter, windowed
from .statements import AddColumn, Argument, Column, CreateFunction, CreateTable, Definition, Distinct, Export, Import, Insert, NextBatch, Passed, Statement, parse_script
from .table_type import TableType, of_connector
from .tokens import ScriptError, Token, after, closing, find, lex, significant, split, sql


@dataclass
class Table:
    """A named table of a script, lazy until something reads it."""

    name: str
    df: DataFrame
    type: TableType = TableType.RELATION
    primary_key: list[str] | None = None
    rowtime: str | None = None
    hints: Hints = field(default_factory=Hints)
    doc: str = ""
    order: list[Order] = field(default_factory=list)
    statement: Statement | None = None
    analysis: Analysis | None = None
    connector: Connector | None = None
    source: CreateTable | None = None
    history: tuple[DataFrame, list[str], str] | None = None  # all versions, key, time
    subscribe: bool = False
    inserted: list[DataFrame] = field(default_factory=list)

    @property
    def visible(self) -> bool:
        return not self.name.split(".")[-1].startswith("_") and not {"no_query", "workload"} & set(self.hints.by_name)


@dataclass
class Function:
    """A parameterised query, or a relationship whose ``parent`` gives the values of ``this``."""

    name: str
    arguments: list[Argument]
    body: list[Token]
    returns: list[Column] | None = None
    parent: str | None = None
    hints: Hints = field(default_factory=Hints)
    doc: str = ""
    subscribe: bool = False


#: Suffixes of files that are not scripts.
_NO_SCRIPTS = (".json", ".jsonl", ".csv", ".avsc", ".parquet", ".gz", ".py", ".jar", ".md", ".txt", ".snapshot", ".yaml", ".yml", ".properties", ".graphqls")
#: Fixed value: the column metadata by which Spark knows a watermark's delay.
_DELAY = "spark.watermarkDelayMs"


#: Joins without a key that deals out their rows are spread over `PARTS` where the product of their tables' bytes exceeds this squared.
SPREAD, PARTS = 1 << 17, 16


def size(df: DataFrame) -> int:
    """Spark's estimate of a frame's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` dealt out by ``keys`` for a join that yields many rows: in partitions that aren't put together for their few bytes, and never sent to all tasks.

    By sizes alone Spark would do both, however often rows were multiplied.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys).hint("merge")


def _view(name: str) -> str:
    return name.replace(".", "__")


class Engine:
    """Runs scripts.

    ``folders``: where IMPORT finds scripts and data. ``streaming``: sources are read as streams. ``tables``: frames
    that scripts can read by name. ``log_folder``: where rows given to `append` are kept (shared by all executors); without one, a new
    folder beside the session's checkpoints. ``asof_bucket``: a duration by which temporal joins cut keys over time too, for keys with a large share of all rows. Definitions are views: nothing is computed before a query, an export or
    `materialize` asks for it, and Catalyst sees through all of them at once.
    """

    def __init__(self, spark: SparkSession, folders: Sequence[str] = (".",), tables: Mapping[str, DataFrame] | None = None, streaming: bool = False, cost_model: str = "DEFAULT", goal: str = "run", log_folder: str | None = None, asof_bucket: str | None = None):
        self.spark, self.folders, self.streaming, self.cost_model, self.goal = spark, list(folders), streaming, cost_model, goal
        self.log_folder, self.asof_bucket = log_folder, asof_bucket
        self.tables: dict[str, Table] = {}
        self.functions: dict[str, Function] = {}
        self.batches: list[list[tuple[str, Any]]] = [[]]
        self.notices: list[str] = []
        self._namespace = ""
        self._last = ""
        spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        for name, df in (tables or {}).items():
            self.register(name, df)

    # ---- tables

    def register(self, name: str, df: DataFrame, type: TableType = TableType.STREAM, primary_key: list[str] | None = None, rowtime: str | None = None) -> Table:
        """A frame as a source table."""
        return self._add(Table(name, df, type, primary_key, rowtime))

    def _add(self, table: Table, replace: bool = False) -> Table:
        key = table.name.lower()
        if not replace and (key in self.tables or key in self.functions):
            raise ScriptError(f"{table.name} is defined twice", table.statement.line if table.statement else 0)
        if not replace:
            self._check_hints(table)
        self.tables[key] = table
        table.df.createOrReplaceTempView(f"`{_view(table.name)}`")
        return table

    def _check_hints(self, table: Table) -> None:
        names = {c.lower() for c in table.df.columns}
        for c in table.hints.columns:
            if c.lower() not in names:
                raise ScriptError(f"a hint of {table.name} names {c}, which is not a column", table.statement.line if table.statement else 0)
        for name in table.hints.unknown:
            self.notices.append(f"{table.name}: hint {name} is not known")
        if keys := table.hints.args("primary_key"):
            table.primary_key = keys
        for name, dim in table.hints.by_name.get("vector_dim", []):
            wrong = F.raise_error(F.lit(f"{table.name}.{name} has a vector whose dimension is not {dim}"))
            c = F.col(f"`{name}`")
            table.df = table.df.withColumn(name, F.when(c.isNull() | (F.size(c) == int(dim)), c).otherwise(wrong))

    def table(self, name: str) -> Table:
        found = self.tables.get(name.lower()) or self.tables.get(f"{self._namespace}{name}".lower())
        if found is None:
            raise ScriptError(f"table {name} is not defined")
        return found

    # ---- what rewriters ask

    def resolve(self, path: tuple[str, ...]) -> str | None:
        name = ".".join(path)
        for candidate in (f"{self._namespace}{name}", name):
            if candidate.lower() in self.tables:
                return f"`{_view(self.tables[candidate.lower()].name)}`"
        return None

    def versions(self, name: str) -> tuple[str, list[str]] | None:
        try:
            table = self.table(name)
        except ScriptError:
            return None
        if table.history:
            df, keys, time = table.history
            view = f"{_view(table.name)}__versions"
            versions(df, keys, time).createOrReplaceTempView(f"`{view}`")
            return view, keys
        if table.type is TableType.LOOKUP and table.primary_key:
            view = f"{_view(table.name)}__versions"
            table.df.withColumn("_valid_from", F.lit("0001-01-01").cast("timestamp_ntz")).withColumn("_valid_to", F.lit(None).cast("timestamp_ntz")).createOrReplaceTempView(f"`{view}`")
            return view, table.primary_key
        return None

    def asof_view(self, left: str, right: str, alias: str, keys: list[tuple[str, str]], left_time: str, how: str, used: set[str] | None) -> str:
        """``used``: columns of the versions that the query names, in lower case; others aren't read."""
        table = self.table(right)
        df, _, time = table.history or (table.df, None, None)
        if time is None:
            raise ScriptError(f"{right} has no times")
        if used is not None:
            needed = used | {b.lower() for _, b in keys} | {time.lower()}
            df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() in needed])
        name = f"_asof_{uuid.uuid4().hex}"
        asof_join(self.table(left).df, df, keys, left_time, time, alias, how, self.asof_bucket).createOrReplaceTempView(f"`{name}`")
        return name

    def binned_view(self, table: str, column: str, low: int, high: int, width: int, name: str) -> str | None:
        """A table with the column ``name``: a row for each bin, ``width`` seconds wide, that the time ``column`` + low to + high seconds touches.

        None for streams, which keep their state by time anyway, and for columns that are no time.
        """
        try:
            df = self.table(table).df
        except ScriptError:
            return None
        kind = {c.lower(): k for c, k in df.dtypes}.get(column.lower())
        if df.isStreaming or kind not in ("timestamp", "timestamp_ntz"):
            return None
        micros = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)" if kind == "timestamp_ntz" else f"unix_micros(`{column}`)"
        first, last = (F.expr(f"floor(({micros} + {x * 1_000_000}) / {width * 1_000_000})") for x in (low, high))
        view = f"_binned_{uuid.uuid4().hex}"
        # a row without a time is in no bin; on the right side, which has low < high, it goes
        df.withColumn(name, first if low == high == 0 else F.explode(F.sequence(first, last))).createOrReplaceTempView(f"`{view}`")
        return view

    def range_views(self, left: tuple[str, str], right: tuple[str, str], low: float, high: float, how: str, spread: bool, names: tuple[str, str]) -> tuple[str, str] | None:
        """Two tables (table, column) with a column of bins each (``names``), equal for rows whose right column is ``low`` to ``high`` above the left one.

        A row of the smaller table (of a left join: the right one) goes to each bin that its interval touches. Where the condition
        has no equality besides (``spread``), few bins may hold most rows: the larger table's rows are then dealt out
        in `PARTS` within each bin, and the smaller's go to each part, so no task gets a whole bin.
        None for streams and for columns that are no numbers.
        """
        sides = []
        for table, column in (left, right):
            try:
                df = self.table(table).df
            except ScriptError:
                return None
            kind = {c.lower(): k for c, k in df.dtypes}.get(column.lower(), "")
            if df.isStreaming or kind.split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
                return None
            sides.append(df)
        if high <= low:
            return None
        sizes = [size(df) for df in sides]
        many = 0 if how == "inner" and sizes[0] < sizes[1] else 1
        wide = spread and sizes[many] <= sizes[1 - many] and sizes[0] * sizes[1] > SPREAD**2
        parts, width = PARTS if wide else 1, (high - low) / 4
        views = []
        for i, df in enumerate(sides):
            x, name = F.col(f"`{(left, right)[i][1]}`").cast("double"), names[i]
            # bins are kept in whole doubles: all numbers beyond share one
            bin_ = lambda v: F.floor(F.least(F.greatest(v / F.lit(width), F.lit(-1e12)), F.lit(1e12)))
            if i == many:
                a, b = (low, high) if i == 0 else (-high, -low)
                # more than sums of doubles can be off by
                slack = (F.abs(x) + F.lit(abs(low) + abs(high))) * F.lit(2e-15)
                bins = F.sequence(bin_(x + F.lit(float(a)) - slack), bin_(x + F.lit(float(b)) + slack))
                if parts > 1:
                    bins = F.flatten(F.transform(bins, lambda v: F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: v * parts + p)))
                df = df.withColumn(name, F.explode(bins))
            else:
                df = df.withColumn(name, bin_(x) * parts + (F.pmod(F.monotonically_increasing_id(), F.lit(parts)) if parts > 1 else F.lit(0)))
            view = f"_binned_{uuid.uuid4().hex}"
            (spread_out(df, [name]) if parts > 1 else df).createOrReplaceTempView(f"`{view}`")
            views.append(view)
        return views[0], views[1]

    def full_view(self, left: str, right: str, names: tuple[str, str], on: list[tuple[str, str]]) -> str | None:
        """The full join of two queries with large keys dealt out; None for small ones, for streams, and for queries that may give other rows when they are read again."""
        try:
            sides = [self.spark.sql(text) for text in (left, right)]
        except AnalysisException:
            return None
        lower = {n.lower() for n in names}
        if any(df.isStreaming or lower & {c.lower() for c in df.columns} or len({c.lower() for c in df.columns}) < len(df.columns) for df in sides):
            return None
        sizes = [size(df) for df in sides]
        if sizes[0] * sizes[1] <= SPREAD**2:
            return None
        for df in sides:
            optimized = df._jdf.queryExecution().optimizedPlan()
            nodes = {re.sub(r"^[\s:+-]*", "", x).split(" ")[0] for x in optimized.toString().split("\n") if x.strip()}
            if not optimized.deterministic() or not all(n.startswith(("Project", "Filter", "Relation", "LocalRelation", "OneRowRelation", "Range", "Union")) for n in nodes):
                return None
        view = f"_full_{uuid.uuid4().hex}"
        if sizes[0] >= sizes[1]:
            out = full_join(sides[0], sides[1], on, names, spread_out)
        else:
            out = full_join(sides[1], sides[0], [(b, a) for a, b in on], names[::-1], spread_out)
        out.createOrReplaceTempView(f"`{view}`")
        return view

    def table_function(self, name: str, args: list[str]) -> str | None:
        f = self.functions.get(name.lower())
        if f is None:
            return None
        given = [a for a in f.arguments if a.computed is None and a.metadata is None]
        if len(args) != len(given):
            raise ScriptError(f"{name} takes {len(given)} arguments, not {len(args)}")
        values = {a.name.lower(): f"CAST({x} AS {a.type})" for a, x in zip(given, args, strict=True)}
        return self._bound(f, values)

    def changelog(self, source: str) -> str:
        table = next((t for t in self.tables.values() if f"`{_view(t.name)}`" == source or t.name.lower() == source.strip("`").lower()), None)
        name = f"_changes_{uuid.uuid4().hex}"
        if table is not None and table.history:
            df, keys, time = table.history
            changes = updates(df, keys, time)
        elif table is not None and isinstance(table.statement, Definition):
            changes = self._aggregate_changes(table)
        else:
            raise ScriptError("TO_CHANGELOG needs a table that DISTINCT or an aggregation defines")
        changes.createOrReplaceTempView(f"`{name}`")
        return f"`{name}`"

    def _aggregate_changes(self, table: Table) -> DataFrame:
        """A row for each time that a row of the source changes an aggregation's result for its key.

        Rows arrive in the order of the source's rowtime. Only rows that the script itself states (VALUES) have an order without one.
        """
        body = table.statement.body
        select, at, by = find(body, "SELECT"), find(body, "FROM"), find(body, "GROUP", "BY")
        where = find(body, "WHERE")
        words = significant(body[at + 1 : where if where >= 0 else by])
        names = [t for t in words if t.is_name and t.upper != "AS"]
        plain = min(select, at, by) >= 0 and all(t.is_name or t.text == "." for t in words) and find(body, "HAVING") < 0 and find(body, "DISTINCT") < 0
        if not plain or not 1 <= len(names) <= 2:
            raise ScriptError(f"TO_CHANGELOG: {table.name} is not a plain aggregation of one table", table.statement.line)
        source = self.table(names[0].name)
        keys = [sql(p) for p in split(significant(body[by:])[2:])]
        leaves = source.df._jdf.queryExecution().optimizedPlan().collectLeaves()
        stated = all(leaves.apply(i).getClass().getSimpleName() in ("LocalRelation", "OneRowRelation") for i in range(leaves.size()))
        if not source.rowtime and not stated:
            raise ScriptError(f"TO_CHANGELOG: {source.name} has no event time, so its changes have no order", table.statement.line)
        order = f"`{source.rowtime}`" if source.rowtime else "`_at`"
        over = f" OVER (PARTITION BY {', '.join(keys)} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        items: list[Token] = []
        chosen, i = body[select + 1 : at], 0
        while i < len(chosen):
            nxt = after(chosen, i + 1)
            items.append(chosen[i])
            if chosen[i].upper in ("COUNT", "SUM", "AVG", "MIN", "MAX") and nxt < len(chosen) and chosen[nxt].text == "(":
                end = closing(chosen, nxt)
                items += [*chosen[i + 1 : end + 1], Token("raw", over)]
                i = end
            i += 1
        held = ", ".join(f"{k} AS `_k{n}`" for n, k in enumerate(keys))
        text = f"SELECT {Rewriter(self).query(items)}, {held}, {order} AS `_order` FROM (SELECT *, monotonically_increasing_id() AS `_at` FROM `{_view(source.name)}`) AS `{names[-1].name}`"
        if where >= 0:
            text += f" {Rewriter(self).query(body[where:by])}"
        df = self.spark.sql(text)
        columns = table.df.columns
        now = F.struct(*[F.col(f"`{c}`") for c in columns])
        w = Window.partitionBy(*[f"_k{n}" for n in range(len(keys))]).orderBy("_order")
        marked = df.withColumn("_was", F.lag(now).over(w)).filter(F.col("_was").isNull() | ~F.col("_was").eqNullSafe(now))
        return marked.select(*columns, F.when(F.col("_was").isNull(), "+I").otherwise("+U").alias("op"))

    def vector_dim(self, column: str) -> int | None:
        found = {int(args[1]) for t in self.tables.values() for args in t.hints.by_name.get("vector_dim", []) if args[0].lower() == column.lower()}
        return found.pop() if len(found) == 1 else None

    def window_view(self, kind: str, source: str, ts: str, spans: list[str]) -> str | None:
        """Of a stream: windows whose end carries the watermark, so that grouping by window_end drops closed windows from the state."""
        table = next((t for t in self.tables.values() if f"`{_view(t.name)}`" == source or t.name.lower() == source.strip("`").lower()), None)
        if table is None or not table.df.isStreaming or kind == "SESSION":
            return None
        column = next((f for f in table.df.schema if f.name.lower() == ts.strip("`").lower()), None)
        delay = column.metadata.get(_DELAY) if column is not None else None
        df = self.spark.sql(f"SELECT * FROM {windowed(kind, source, ts, spans)}")
        if delay is not None:
            marked = {"window_end": {_DELAY: delay}}
            df = df.select(*[F.col(f"`{c}`").alias(c, metadata=marked[c]) if c in marked else F.col(f"`{c}`") for c in df.columns])
        name = f"_windows_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(f"`{name}`")
        return f"`{name}`"

    # ---- scripts

    def run(self, script: str) -> Engine:
        """Plan all statements of a script; `execute` then does its exports and inserts."""
        for s in parse_script(script):
            self._plan(s)
        return self

    def _plan(self, s: Statement) -> None:
        self._planned(s)
        # a column may be added to the definition just before, not to any other
        self._last = self._namespace + (s.table if isinstance(s, AddColumn) else ".".join(s.name) if isinstance(s, Definition) else getattr(s, "name", ""))

    def _planned(self, s: Statement) -> None:
        if "test" in s.hints and self.goal != "test" and isinstance(s, Definition | Distinct):
            return
        if isinstance(s, Import):
            self._import(s)
        elif isinstance(s, Export):
            self.batches[-1].append(("export", (self.table(".".join(s.table)), s.target, s.line)))
        elif isinstance(s, CreateTable):
            self._create(s)
        elif isinstance(s, Distinct):
            self._distinct(s)
        elif isinstance(s, AddColumn):
            self._add_column(s)
        elif isinstance(s, Definition):
            self._define(s)
        elif isinstance(s, Insert):
            self._insert(s)
        elif isinstance(s, NextBatch):
            if not self.batches[-1]:
                raise ScriptError("NEXT_BATCH ends a batch without exports or inserts", s.line)
            self.batches.append([])
        elif isinstance(s, CreateFunction):
            self.register_function(s.name, python_functions.load_function(s.target))
        elif isinstance(s, Passed):
            self.spark.sql(sql(s.body))

    def register_function(self, name: str, f: Callable, returns: str | None = None) -> None:
        """A Python function for SQL: ``f`` is a Spark UDF, a UDTF or a Pandas UDF, or a plain function with ``returns``."""
        if hasattr(f, "evalType") and not hasattr(f, "returnType"):
            self.spark.udtf.register(name, f)
        elif type(f).__name__ == "UserDefinedTableFunction":
            self.spark.udtf.register(name, f)
        else:
            self.spark.udf.register(name, f, returns) if returns else self.spark.udf.register(name, f)

    def _sql(self, body: list[Token], line: int) -> DataFrame:
        """A query's frame; temporal joins by one sort where the query allows it, else by validity intervals.

        Interval joins are binned; `_plain_form` then is the query as it was said, for the analysis of types and keys.
        """
        self._undeclared(body, [], line)
        self._plain_form = None
        for linear in (True, False):
            rewriter = Rewriter(self, linear)
            try:
                # the validity of versions is no column of theirs
                df = self.spark.sql(rewriter.query(body)).drop("_valid_from", "_valid_to")
                if rewriter.used_bins:
                    self._plain_form = self.spark.sql(Rewriter(self, False).query(body)).drop("_valid_from", "_valid_to")
                return df
            except AnalysisException as e:
                if linear and (rewriter.used_asof or rewriter.used_bins):
                    continue
                raise ScriptError(str(e).split("\n")[0], line) from e
        raise AssertionError

    @staticmethod
    def _undeclared(body: list[Token], declared: Sequence[str], line: int) -> None:
        words = significant(body)
        for a, b in zip(words, words[1:], strict=False):
            if a.text == ":" and b.is_name and b.name.lower() not in {d.lower() for d in declared}:
                raise ScriptError(f"argument {b.name} is not declared", b.line or line)

    def _define(self, s: Definition) -> None:
        name = self._namespace + ".".join(s.name)
        if len(s.name) == 2:
            self._relationship(s)
            return
        if s.arguments is not None:
            self._function(name, s)
            return
        body, order = (s.body, []) if s.returns is not None else self._pulled_order(s.body)
        df = self._passthrough(s) if s.returns is not None else self._sql(body, s.line)
        for column, *_ in order:
            if column.lower() not in {c.lower() for c in df.columns}:
                raise ScriptError(f"{name} is sorted by {column}, which it does not select", s.line)
        names = [c.lower() for c in df.columns]
        if len(set(names)) < len(names):
            df = df.toDF(*self._unique(df.columns))
        self._add_query(name, df, s, order)

    def _add_query(self, name: str, df: DataFrame, s: Definition, order: list[Order]) -> None:
        table = Table(name, df, hints=s.hints, doc=s.doc, order=order, statement=s, subscribe=s.subscribe)
        plain, self._plain_form = getattr(self, "_plain_form", None), None
        if plain is not None and len(set(plain.columns)) < len(plain.columns):
            plain = plain.toDF(*self._unique(plain.columns))
        table.analysis, table.primary_key, table.rowtime = Analyzer(self._known).analyze(df if plain is None else plain)
        table.type = table.analysis.type
        text = " ".join(t.upper for t in significant(s.body))
        if "FOR SYSTEM_TIME AS OF" in text:
            table.type = TableType.STREAM
        self.notices += [f"{name}: {n}" for n in table.analysis.notices]
        where, grouped = find(s.body, "WHERE"), find(s.body, "GROUP", "BY")
        if 0 <= where < grouped and any(t.upper in ("NOW", "CURRENT_TIMESTAMP") for t in s.body[where:grouped]) and "WINDOW_START" not in text:
            self.notices.append(f"{name}: it aggregates the rows since some time before now; a HOP window would give the same as a stream")
        self._add(table)
        for kind, how in (("query_by_all", "all"), ("query_by_any", "any")):
            for columns in s.hints.by_name.get(kind, []):
                self._access(table, columns, how)

    def _known(self, name: str) -> Known | None:
        for t in self.tables.values():
            if _view(t.name).lower() == name.lower():
                return Known(t.type, t.primary_key, t.rowtime)
        return None

    @staticmethod
    def _unique(names: list[str]) -> list[str]:
        """Columns of one name get numbers: ``a, a0, a1``."""
        out: list[str] = []
        for n in names:
            taken, i, new = {x.lower() for x in out}, 0, n
            while new.lower() in taken:
                new, i = f"{n}{i}", i + 1
            out.append(new)
        return out

    @staticmethod
    def _pulled_order(body: list[Token]) -> tuple[list[Token], list[Order]]:
        """A query without its last ORDER BY, which is applied on reading; with a LIMIT it stays."""
        at = nxt = find(body, "ORDER", "BY")
        while nxt >= 0:
            at, nxt = nxt, find(body, "ORDER", "BY", start=nxt + 1)
        if at < 0 or any(find(body, w, start=at) >= 0 for w in ("LIMIT", "OFFSET", "FETCH")):
            return body, []
        out: list[Order] = []
        rest = significant(body[at:])[2:]
        for part in split(rest):
            words = [t for t in part]
            said = []
            while words and words[-1].upper in ("ASC", "DESC", "NULLS", "FIRST", "LAST"):
                said.append(words.pop().upper)
            if not words or not all(t.is_name or t.text == "." for t in words):
                return body, []
            last = True if "LAST" in said else False if "FIRST" in said else None
            out.append((words[-1].name, "DESC" in said, last))
        return body[:at], out

    def _passthrough(self, s: Definition) -> DataFrame:
        """Spark's own SQL, unchanged, with its columns cast to the declared ones."""
        df = self.spark.sql(sql(s.body))
        if len(df.columns) != len(s.returns):
            raise ScriptError(f"{'.'.join(s.name)} returns {len(df.columns)} columns; {len(s.returns)} are declared", s.line)
        return df.select(*[F.col(f"`{a}`").cast(c.type).alias(c.name) for a, c in zip(df.columns, s.returns, strict=True)])

    def _function(self, name: str, s: Definition) -> None:
        if name.lower() in self.functions or name.lower() in self.tables:
            raise ScriptError(f"{name} is defined twice; functions cannot be overloaded", s.line)
        self._undeclared(s.body, [a.name for a in s.arguments], s.line)
        self.functions[name.lower()] = Function(name, s.arguments, s.body, s.returns, None, s.hints, s.doc, s.subscribe)

    def _relationship(self, s: Definition) -> None:
        name = self._namespace + ".".join(s.name)
        parent = self.table(s.name[0])
        if name.lower() in self.functions:
            raise ScriptError(f"{name} is defined twice", s.line)
        if s.name[1].lower() in {c.lower() for c in parent.df.columns}:
            raise ScriptError(f"{name} has the name of a column", s.line)
        args = s.arguments or []
        self._undeclared(s.body, [a.name for a in args], s.line)
        words = significant(s.body)
        for i, t in enumerate(words[:-2]):
            if t.upper == "THIS" and words[i + 1].text == "." and words[i + 2].name.lower() not in {c.lower() for c in parent.df.columns}:
                raise ScriptError(f"{parent.name} has no column {words[i + 2].name}", s.line)
        self.functions[name.lower()] = Function(name, args, s.body, s.returns, parent.name, s.hints, s.doc)

    def _access(self, table: Table, columns: list[str], how: str) -> None:
        types = dict(table.df.dtypes)
        lower = {c.lower(): c for c in types}
        nullable = {f.name: f.nullable for f in table.df.schema}
        columns = [lower[c.lower()] for c in columns]
        if how == "any":
            tests = [f"(`{c}` = :{c} OR :{c} IS NULL)" for c in columns]
        else:
            tests = [f"`{c}` <=> :{c}" if nullable[c] else f"`{c}` = :{c}" for c in columns]
        text = f"SELECT * FROM `{_view(table.name)}` WHERE {' AND '.join(tests)}"
        args = [Argument(c, types[c], nullable=how == "any") for c in columns]
        self.functions[f"{table.name}.by_{how}".lower()] = Function(f"{table.name}.by_{how}", args, lex(text))

    def _distinct(self, s: Distinct) -> None:
        source = self.table(s.source)
        lower = {c.lower(): c for c in source.df.columns}
        for c in [*s.keys, *[c for c, *_ in s.order]]:
            if c.lower() not in lower:
                raise ScriptError(f"{s.source} has no column {c}", s.line)
        keys, order = [lower[k.lower()] for k in s.keys], [(lower[c.lower()], d, n) for c, d, n in s.order]
        single = order[0] if len(order) == 1 and order[0][1] else None
        latest = single is not None and single[0] == source.rowtime
        if "filtered_distinct_order" in s.hints and single and not latest:
            df = filtered_distinct(source.df, keys, single[0], source.rowtime)
        elif source.df.isStreaming:
            df = source.df  # resolved where it is written, by the state table's key
        else:
            df = distinct_on(source.df, keys, order)
        kind = TableType.VERSIONED_STATE if source.type in (TableType.STREAM, TableType.VERSIONED_STATE) else TableType.STATE
        history = (source.df, keys, order[0][0]) if order[0][1] else None
        table = Table(self._namespace + s.name, df, kind, keys, order[0][0], s.hints, s.doc, statement=s, history=history)
        self._add(table)
        for name, how in (("query_by_all", "all"), ("query_by_any", "any")):
            for columns in s.hints.by_name.get(name, []):
                self._access(table, columns, how)

    def _add_column(self, s: AddColumn) -> None:
        table = self.table(s.table)
        if table.source is not None or self._last.lower() != table.name.lower():
            raise ScriptError(f"a column of {s.table} must follow the definition of {s.table}", s.line)
        value = Rewriter(self).query(s.expression)
        try:
            df = table.df.withColumn(s.column, F.expr(value))
        except AnalysisException as e:
            raise ScriptError(str(e).split("\n")[0], s.line) from e
        history = None
        if table.history:
            rows, keys, time = table.history
            history = (rows.withColumn(s.column, F.expr(value)), keys, time)
        table.df, table.history = df, history
        self._add(table, replace=True)

    def _insert(self, s: Insert) -> None:
        table = self.table(s.table)
        df = self._sql(s.body, s.line)
        columns = s.columns or table.df.columns
        if len(columns) != len(df.columns):
            raise ScriptError(f"INSERT INTO {s.table} gives {len(df.columns)} columns for {len(columns)}", s.line)
        df = df.toDF(*columns)
        types = {f.name: f.dataType for f in table.df.schema}
        row = df.select(*[(F.col(f"`{c}`") if c in columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
        self.batches[-1].append(("insert", (table, row)))
        if table.connector is None:
            table.inserted.append(row)
            table.df = table.df.unionByName(row)
            self._add(table, replace=True)

    # ---- sources

    def _create(self, s: CreateTable) -> None:
        name = self._namespace + s.name
        connector = Connector(dict(s.options))
        if s.like and files_format(s.like):
            path = self._file(s.like)
            found = discover(self.spark, path)
            declared = {c.name for c in s.columns}
            s.columns = [*[Column(f.name, f.dataType.simpleString()) for f in found if f.name not in declared], *s.columns]
            if files_format(s.like) != "avsc" and not connector.kind:
                kind = files_format(s.like)
                connector = Connector({"connector": "filesystem", "format": f"flexible-{kind}" if kind in ("json", "csv") else kind, "path": path} | dict(s.options))
        if "path" in connector.options and "://" not in connector.options["path"] and not os.path.isabs(connector.options["path"]):
            connector = Connector(dict(connector.options) | {"path": self._file(connector.options["path"])})
        plain = [c for c in s.columns if c.computed is None and c.metadata is None]
        schema = T.StructType([T.StructField(c.name, self._type(c.type), True) for c in plain])
        if not connector.kind:
            if "engine" not in s.hints:
                raise ScriptError(f"{name} has neither a connector nor an engine hint", s.line)
            full = T.StructType([T.StructField(c.name, self._type(c.type), c.nullable and c.metadata is None) for c in s.columns if c.computed is None])
            df, kind = self.spark.createDataFrame([], full), TableType.VERSIONED_STATE if s.primary_key else TableType.STREAM
        elif connector.kind in SINKS:
            df, kind = self.spark.createDataFrame([], schema), TableType.RELATION
        else:
            kind = of_connector(connector.kind)
            stamped = [c for c in s.columns if c.metadata == "timestamp"] if connector.kind.endswith(("kafka", "kafka-safe")) else []
            if stamped or s.primary_key:  # the log's own key and time
                connector = Connector({"key.fields": ";".join(s.primary_key or [])} | {"timestamp-column": c.name for c in stamped} | dict(connector.options))
            df = self._read(connector, T.StructType([*schema, *(T.StructField(c.name, self._type(c.type), True) for c in stamped)]))
            for c in s.columns:
                if c.metadata is not None and c not in stamped:
                    df = df.withColumn(c.name, self._metadata(c).cast(c.type or "string"))
        rewriter = Rewriter(self)
        for c in s.columns:
            if c.computed is not None:
                df = df.withColumn(c.name, F.expr(rewriter.query(lex(c.computed))))
        order = [c.name for c in s.columns if c.name in df.columns]
        df = df.select(*[F.col(f"`{c}`") for c in order])
        rowtime = s.watermark[0] if s.watermark else next((c.name for c in s.columns if c.metadata == "timestamp"), None)
        if s.watermark and df.isStreaming:
            df = df.withWatermark(s.watermark[0], self._delay(s.watermark[1]))
        key = s.primary_key or ([c.name for c in s.columns if c.metadata == "uuid"][:1] or None)
        history = (df, key, rowtime) if kind is TableType.VERSIONED_STATE and key and rowtime else None
        self._add(Table(name, df, kind, key, rowtime, s.hints, s.doc, statement=s, connector=connector if connector.kind else None, source=s, history=history))

    def _read(self, connector: Connector, schema: T.StructType) -> DataFrame:
        try:
            return connector.read(self.spark, schema if len(schema) else None, self.streaming)
        except AnalysisException as e:
            if len(schema) and "PATH_NOT_FOUND" in str(e):  # nothing has been written there yet; a folder that is there can be listed again
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(connector.path)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
                return connector.read(self.spark, schema, self.streaming)
            raise

    @staticmethod
    def _metadata(c: Column):
        if c.metadata == "uuid":
            return F.expr("uuid()")
        if c.metadata == "timestamp":
            return F.current_timestamp()
        return F.lit(None)

    def _type(self, text: str | None) -> T.DataType:
        return self.spark.sql(f"SELECT CAST(NULL AS {text or 'STRING'}) AS c").schema[0].dataType

    @staticmethod
    def _delay(expression: str) -> str:
        m = re.search(r"INTERVAL\s+'?([\d.]+)'?\s+(\w+)", expression, re.IGNORECASE)
        if not m:
            return "0 seconds"
        if "." in m[1]:
            return f"{round(float(m[1]) * 1000)} milliseconds"
        return f"{m[1]} {m[2].lower()}"

    def _file(self, path: str) -> str:
        for folder in self.folders:
            if os.path.exists(full := os.path.join(folder, path)):
                return full
        return path

    def _import(self, s: Import) -> None:
        """``a.b.*``, ``a.b`` or ``a.b.T``: scripts, table files or functions; an alias or a whole script sets a namespace."""
        path = list(s.path)
        if path[0] == "stdlib":
            python_functions.register(self.spark)
            return
        every, single = path[-1] == "*", None
        if every:
            path = path[:-1]
        for folder in self.folders:
            base = os.path.join(folder, *path)
            if script := self._script(base):
                return self._inline(script, "" if every else (s.alias or path[-1]) + ".")
            if every and os.path.isdir(base):
                for name in sorted(os.listdir(base)):
                    if name.endswith(".table.sql"):
                        self._inline(os.path.join(base, name), f"{s.alias}." if s.alias else "")
                return None
            if os.path.exists(f"{base}.table.sql"):
                return self._inline(f"{base}.table.sql", "", rename=s.alias)
            if os.path.isdir(base):
                for name in sorted(os.listdir(base)):
                    if name.endswith(".table.sql"):
                        self._inline(os.path.join(base, name), f"{s.alias or path[-1]}.")
                return None
            parent = os.path.join(folder, *path[:-1])
            if len(path) > 1 and (script := self._script(parent)):
                single = (script, path[-1])
        if single:
            inner = Engine(self.spark, [os.path.dirname(single[0]), *self.folders], streaming=self.streaming)
            with open(single[0], encoding="utf-8") as f:
                inner.run(f.read())
            found = inner.table(single[1])
            found.name = s.alias or single[1]
            self._add(found)
            return None
        found = [t for t in self.tables.values() if t.name.lower() == path[-1].lower()]
        if found:  # given as a frame
            if s.alias:
                self.register(s.alias, found[0].df, found[0].type, found[0].primary_key, found[0].rowtime)
            return None
        try:
            f = python_functions.load_function(".".join(path))
        except (ImportError, AttributeError, ValueError):
            raise ScriptError(f"nothing to import at {'.'.join(s.path)}", s.line) from None
        self.register_function(s.alias or path[-1], f)
        return None

    @staticmethod
    def _script(base: str) -> str | None:
        """The script file of a name: of any suffix that isn't one of data."""
        folder, stem = os.path.split(base)
        for name in sorted(os.listdir(folder or ".")) if os.path.isdir(folder or ".") else ():
            root, suffix = os.path.splitext(name)
            if root == stem and suffix and suffix not in _NO_SCRIPTS and os.path.isfile(os.path.join(folder, name)):
                return os.path.join(folder, name)
        return None

    def _inline(self, file: str, namespace: str, rename: str | None = None) -> None:
        with open(file, encoding="utf-8") as f:
            statements = parse_script(f.read())
        outer, folders = self._namespace, self.folders
        self._namespace, self.folders = outer + namespace, [os.path.dirname(file), *folders]
        try:
            for s in statements:
                if rename and isinstance(s, CreateTable):
                    s.name = rename
                self._plan(s)
        finally:
            self._namespace, self.folders = outer, folders

    # ---- queries

    def _bound(self, f: Function, values: Mapping[str, str]) -> str:
        """A function's body with SQL texts for its arguments."""
        out: list[Token] = []
        words = list(f.body)
        i = 0
        while i < len(words):
            t = words[i]
            if t.text == ":" and i + 1 < len(words) and words[i + 1].is_name and words[i + 1].name.lower() in values:
                out.append(Token("raw", f"({values[words[i + 1].name.lower()]})"))
                i += 2
                continue
            out.append(t)
            i += 1
        return sql(out) if f.returns is not None else Rewriter(self, linear=False).query(out)

    def _arguments(self, f: Function, given: Mapping[str, Any], auth: Mapping[str, Any] | None) -> tuple[dict[str, str], dict[str, Any]]:
        """SQL texts with markers, and the markers' values."""
        texts, values = {}, {}
        lower = {k.lower(): v for k, v in given.items()}
        known = {a.name.lower() for a in f.arguments}
        if extra := set(lower) - known:
            raise ScriptError(f"{f.name} has no argument {sorted(extra)[0]}")
        for a in f.arguments:
            name = a.name.lower()
            if a.metadata is not None:
                value: Any = auth
                for part in a.metadata.split(".")[1:]:
                    value = value.get(part) if isinstance(value, Mapping) else None
                if value is None and not a.nullable:
                    raise PermissionError(f"{f.name} needs {a.metadata}")
            elif a.computed is not None:
                texts[name] = f"CAST({self._computed(a.computed, texts)} AS {a.type})"
                continue
            else:
                value = lower.get(name)
                if value is None and not a.nullable:
                    raise ScriptError(f"{f.name} needs a value for {a.name}")
            texts[name] = f"CAST(:{name} AS {a.type})"
            values[name] = value
        return texts, values

    def _computed(self, expression: str, texts: Mapping[str, str]) -> str:
        text = Rewriter(self).text(expression)
        return re.sub(r":(\w+)", lambda m: texts.get(m[1].lower(), m[0]), text)

    def query(self, name: str, limit: int | None = None, offset: int | None = None, auth: Mapping[str, Any] | None = None, **args: Any) -> DataFrame:
        """The rows of a table, or of a function with its arguments, in their declared order."""
        f = self.functions.get(name.lower())
        if f is not None and f.parent is None:
            texts, values = self._arguments(f, args, auth)
            body = self._bound(f, texts)
            used = {k: v for k, v in values.items() if f":{k}" in body}
            df = self.spark.sql(body, args=used) if used else self.spark.sql(body)
            if f.returns is not None:
                df = df.select(*[F.col(f"`{a}`").cast(c.type).alias(c.name) for a, c in zip(df.columns, f.returns, strict=True)])
        else:
            table = self.table(name)
            if args:
                raise ScriptError(f"{name} takes no arguments")
            df = table.df.orderBy(*ordering(table.order)) if table.order else table.df
        if offset:
            df = df.offset(offset)
        return df.limit(limit) if limit is not None else df

    def relationship(self, name: str, parents: DataFrame | None = None, auth: Mapping[str, Any] | None = None, **args: Any) -> DataFrame:
        """All parents with the rows of a relationship: a struct column ``this`` and the relationship's columns.

        One lateral join for all parents, which Spark turns into a plain join on what ``this`` is compared with.
        """
        f = self.functions[name.lower()]
        if f.parent is None:
            raise ScriptError(f"{name} is not a relationship")
        parent = parents if parents is not None else self.table(f.parent).df
        view = f"_parents_{uuid.uuid4().hex}"
        parent.createOrReplaceTempView(view)
        texts, values = self._arguments(f, args, auth)
        body = re.sub(r"(?i)\bthis\s*\.", "`_p`.", self._bound(f, texts))
        used = {k: v for k, v in values.items() if f":{k}" in body}
        row = f"named_struct({', '.join(f'{chr(39)}{c}{chr(39)}, `_p`.`{c}`' for c in parent.columns)})"
        text = f"SELECT {row} AS this, `_r`.* FROM {view} AS `_p`, LATERAL ({body}) AS `_r`"
        return self.spark.sql(text, args=used) if used else self.spark.sql(text)

    def page(self, name: str, limit: int = PAGE_SIZE, offset: int = 0, fields: tuple[str, ...] = ("hasNextPage",), **args: Any) -> Page:
        rowtime = self.tables[name.lower()].rowtime if name.lower() in self.tables else None
        return page(self.query(name, **args), limit, offset, fields, rowtime)

    def catalog(self) -> dict[str, list[str]]:
        """What a client may ask for: visible tables and functions, and their columns or arguments."""
        out = {t.name: t.df.columns for t in self.tables.values() if t.visible}
        return out | {f.name: [a.name for a in f.arguments if a.metadata is None and a.computed is None] for f in self.functions.values() if not f.name.startswith("_") and "no_query" not in f.hints}

    # ---- running

    def stages(self) -> dict[str, str]:
        """View or table for each definition, by the cost model."""
        readers: dict[str, int] = {}
        for t in self.tables.values():
            for n in t.analysis.sources if t.analysis else ():
                readers[n.lower()] = readers.get(n.lower(), 0) + 1
        out = {}
        for t in self.tables.values():
            if t.analysis:
                pin = {"flink": "table", "postgres": "view", "spark": "table"}.get((t.hints.args("engine") or [""])[0].lower())
                out[t.name] = stage(Node(t.name, t.analysis.join_cost, readers.get(_view(t.name).lower(), 0), t.hints.row_count, pin), self.cost_model)
        return out

    def materialize(self, folder: str, names: Sequence[str] | None = None) -> list[str]:
        """Write definitions to ``folder`` (shared by all executors) and read them back from there; by default those that the cost model stores."""
        chosen = list(names) if names is not None else [n for n, s in self.stages().items() if s == "table"]
        for n in chosen:
            table = self.table(n)
            path = f"{folder.rstrip('/')}/{_view(table.name)}"
            by = table.hints.args("partition_key") or []
            writer = self.retained(table).write.mode("overwrite")
            (writer.partitionBy(*by) if by else writer).parquet(path)
            table.df = self.spark.read.parquet(path)
            self._add(table, replace=True)
        return chosen

    def retained(self, table: Table) -> DataFrame:
        """A table's rows without those older than its ``ttl``, by its rowtime."""
        seconds = table.hints.seconds("ttl")
        return expired(table.df, table.rowtime, seconds) if seconds and table.rowtime else table.df

    def append(self, name: str, rows: DataFrame | Sequence[Mapping[str, Any]]) -> None:
        """Rows for a table that the engine manages; metadata columns are filled in, and rows must have all other columns that are not null.

        With the hint ``insert(TRANSACTION)`` or ``insert(BATCH)`` all rows are checked before any is taken; by default (SINGLE) rows that break a NOT NULL are refused one by one.
        """
        table = self.table(name)
        if table.source is None or table.connector is not None:
            raise ScriptError(f"{name} takes no rows")
        columns = [c for c in table.source.columns if c.computed is None]
        if not isinstance(rows, DataFrame):
            given = T.StructType([T.StructField(c.name, self._type(c.type), True) for c in columns if c.metadata is None])
            rows = self.spark.createDataFrame([tuple(r.get(f.name) for f in given) for r in rows], given)
        for c in columns:
            if c.metadata is not None and c.name not in rows.columns:
                rows = rows.withColumn(c.name, self._metadata(c))
        rows = rows.select(*[F.col(f"`{c.name}`").cast(self._type(c.type)).alias(c.name) for c in columns])
        needed = [c.name for c in columns if not c.nullable and c.metadata is None]
        whole = F.lit(True)
        for c in needed:
            whole = whole & F.col(f"`{c}`").isNotNull()
        if (table.hints.args("insert") or ["SINGLE"])[0].upper() == "SINGLE":
            rows = rows.filter(whole)
        elif needed and not rows.filter(~whole).isEmpty():
            raise ValueError(f"{name}: a row lacks one of {', '.join(needed)}; none was taken")
        # values such as uuid() must not change from one reading to the next
        rows = self._logged(table, rows)
        table.inserted.append(rows)
        table.df = table.df.unionByName(rows)
        if table.history:
            table.history = (table.df, *table.history[1:])
        self._add(table, replace=True)

    def _logged(self, table: Table, rows: DataFrame) -> DataFrame:
        if self.log_folder is None:
            self.log_folder = scratch(self.spark, "log")
        path = f"{self.log_folder.rstrip('/')}/{_view(table.name)}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def subscribe(self, name: str, callback: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
        """New rows of a streaming table, batch after batch; gives the running query. Rows of a table of state are its changes."""
        df = self.table(name).df
        if not df.isStreaming:
            raise ScriptError(f"{name} is not a stream")
        writer = df.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def compact(self, folder: str, name: str, rows_per_file: int = 5_000_000) -> None:
        """Rewrite a materialized table in fewer, larger files, sorted by its ``index`` columns so that readers can skip."""
        table = self.table(name)
        path = f"{folder.rstrip('/')}/{_view(table.name)}_{uuid.uuid4().hex}"
        by = table.hints.args("partition_key") or []
        keys = [c for args in table.hints.by_name.get("index", []) for c in args[1:]] or table.primary_key or []
        files = max(1, -(-table.df.count() // rows_per_file))
        rows = table.df.repartitionByRange(files, *[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{k}`") for k in keys]) if keys else table.df.repartition(files)
        (rows.write.partitionBy(*by) if by else rows.write).parquet(path)
        table.df = self.spark.read.parquet(path)
        self._add(table, replace=True)

    def execute(self, folder: str | None = None) -> list[Any]:
        """Exports and inserts, batch after batch; a failure stops all later ones, and a batch reads what those before it have written. Streams give their running queries."""
        running = []
        for number, batch in enumerate(self.batches):
            if number:
                self._refresh()
            for kind, action in batch:
                if kind == "export":
                    table, target, line = action
                    running.append(self._export(table, target, line, folder))
                else:
                    table, rows = action
                    if table.connector is not None:
                        running.append(table.connector.write(rows, "append", table.source.partitioned_by if table.source else None, keys=table.primary_key, time=table.rowtime))
        self.batches = [[]]
        return [r for r in running if r is not None]

    def _refresh(self) -> None:
        """List the files of all tables with a connector again; definitions over them see the new ones."""
        for table in self.tables.values():
            if table.connector is not None and not table.df.isStreaming:
                leaves = table.df._jdf.queryExecution().analyzed().collectLeaves()
                for leaf in (leaves.apply(i) for i in range(leaves.size())):
                    if leaf.getClass().getSimpleName() == "LogicalRelation" and "HadoopFsRelation" in leaf.relation().getClass().getName():
                        leaf.relation().location().refresh()

    def _export(self, table: Table, target: tuple[str, ...], line: int, folder: str | None):
        df = table.df.orderBy(*ordering(table.order)) if table.order and not table.df.isStreaming else table.df
        if target[0] in ("print", "logger", "log"):
            return Connector({"connector": target[0]}).write(df)
        sink = self.tables.get(".".join(target).lower()) or self.tables.get(target[-1].lower())
        if sink is not None and sink.connector is not None:
            return sink.connector.write(df.select(*[c for c in sink.df.columns if c in df.columns] or df.columns), "append", table.hints.args("partition_key"), keys=sink.primary_key, time=sink.rowtime)
        if folder is None:
            raise ScriptError(f"EXPORT to {'.'.join(target)}: no such sink, and no folder is given", line)
        by = table.hints.args("partition_key")
        return Connector({"connector": "filesystem", "format": "parquet", "path": os.path.join(folder, *target)}).write(df, "overwrite", by)
