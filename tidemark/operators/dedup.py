"""One row for each key: by an order, or by an order after rows that change nothing are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType
from pyspark.sql.window import Window

#: (column, descending, nulls last or None for the default)
Order = tuple[str, bool, bool | None]


def ordering(order: Sequence[Order]) -> list[Column]:
    """Nulls are low by default: first ascending, last descending."""
    out = []
    for name, descending, nulls_last in order:
        c = F.col(f"`{name}`")
        last = descending if nulls_last is None else nulls_last
        out.append((c.desc_nulls_last() if last else c.desc_nulls_first()) if descending else (c.asc_nulls_last() if last else c.asc_nulls_first()))
    return out


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Order]) -> DataFrame:
    """The first row of each key in ``order``.

    A single descending column of non-null rows is an aggregation (`max_by` of the whole row), which is
    combined before the shuffle, so a key with a third of the rows is no burden; other
    orders rank the rows of a key, for which Spark keeps just the first of each map task
    (a window group limit). Rows that tie in ``order``: one with the largest values stays where
    the row can be compared, any one else.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    comparable = not any(isinstance(f.dataType, MapType) or "variant" in f.dataType.simpleString() for f in df.schema)
    if len(order) == 1 and order[0][1] and order[0][2] is not False and comparable:
        time = F.col(f"`{order[0][0]}`")
        # a null time is below all others
        best = F.max(F.struct(time.isNotNull().alias("known"), time.alias("time"), F.struct(*columns).alias("row")))
        return df.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best.alias("_best")).select("_best.row.*")
    ties = [F.struct(*columns).desc()] if comparable else []
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*ordering(order), *ties)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def filtered_distinct(df: DataFrame, keys: Sequence[str], order: str, time: str | None = None) -> DataFrame:
    """`distinct_on` by ``order`` descending after two filters, in the order of ``time`` (by default ``order``).

    A row stays if ``order`` is not below any earlier row's, and of those if it is the key's first or
    differs from the one before it in a column besides keys, ``order`` and ``time``. The
    row that is left can so have an older time than the key's last row.
    """
    time = time or order
    if any(isinstance(f.dataType, StructType | ArrayType | MapType) for f in df.schema):
        raise ValueError("a filtered distinct takes no nested columns")
    rest = [c for c in df.columns if c not in (*keys, order, time)]
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(F.col(f"`{time}`"), F.col(f"`{order}`"), *[F.col(f"`{c}`") for c in rest])
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    kept = df.withColumn("_top", F.max(f"`{order}`").over(running)).filter(F.col(f"`{order}`") >= F.col("_top")).drop("_top")
    changed = F.lag(F.lit(1)).over(w).isNull()
    for c in rest:
        changed = changed | ~F.col(f"`{c}`").eqNullSafe(F.lag(f"`{c}`").over(w))
    return distinct_on(kept.withColumn("_changed", changed).filter("_changed").drop("_changed"), keys, [(order, True, None)])


def changelog(df: DataFrame, keys: Sequence[str], order: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Each update of an aggregation as a row of its own: the aggregates over a key's rows up to each row, in ``order``.

    ``order`` must give the arrival; a table has none of its own.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*keys, *order, *[a.over(w).alias(name) for name, a in aggregates.items()])


def updates(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows that became the current one of their key, with op: ``+I`` for the first, ``+U`` for later ones."""
    w = Window.partitionBy(*keys).orderBy(order)
    best = F.max(order).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_best", best).withColumn("op", F.when(F.col("_best").isNull(), "+I").otherwise("+U"))
    return marked.filter(F.col("_best").isNull() | (F.col(order) >= F.col("_best"))).drop("_best")
