"""Joins that Spark has no operator for: as-of (temporal) joins and interval joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.hints import duration


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], left_time: str, right_time: str, alias: str, how: str = "inner", bucket: str | None = None) -> DataFrame:
    """``left`` with a struct column ``alias``: the row of ``right`` of the same key with the latest time not after ``left_time``.

    Both sides are put in one order by key and time, and each left row takes the last
    right row before it: one shuffle and one sort, whatever the number of versions, where a
    range join would compare all versions of a key. Rows of ``right`` with equal times
    for a key: the one with the largest values in the order of its columns counts. A null time or
    key matches nothing; ``how`` is inner (misses go) or left (misses keep a null struct).

    ``bucket``, a duration like ``1 day``, splits keys over time as well, for keys that
    hold a large share of all rows: a task gets one key's rows of one bucket, and the last version
    before each bucket is carried into it (as a row without a time, which sorts first) from a table of one row for each
    key and bucket.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    version = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    none_l, none_r = F.lit(None).cast(left.select(row).schema[0].dataType), F.lit(None).cast(right.select(version).schema[0].dataType)
    ours = left.select(*[F.col(f"`{a}`").alias(k) for (a, _), k in zip(on, keys, strict=True)], F.col(f"`{left_time}`").alias("_t"), F.lit(1).alias("_side"), row.alias("_l"), none_r.alias("_r"))
    theirs = right.select(*[F.col(f"`{b}`").alias(k) for (_, b), k in zip(on, keys, strict=True)], F.col(f"`{right_time}`").alias("_t"), F.lit(0).alias("_side"), none_l.alias("_l"), version.alias("_r"))
    known = [F.col(c).isNotNull() for c in [*keys, "_t"]]
    usable = known[0]
    for k in known[1:]:
        usable = usable & k
    theirs = theirs.filter(usable)
    by = list(keys)
    if bucket:
        ours, theirs = (d.withColumn("_b", _bucket(d, bucket)) for d in (ours, theirs))
        ends = theirs.groupBy(*keys, "_b").agg(F.max_by("_r", F.struct("_t", "_r")).alias("_last"))
        needed = ours.select(*keys, "_b").distinct().withColumn("_last", none_r)
        every = ends.unionByName(needed).groupBy(*keys, "_b").agg(F.first("_last", ignorenulls=True).alias("_last"))
        earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.withColumn("_r", F.last("_last", ignorenulls=True).over(earlier)).filter(F.col("_r").isNotNull())
        theirs = theirs.unionByName(carried.select(*keys, F.lit(None).cast(ours.schema["_t"].dataType).alias("_t"), F.lit(-1).alias("_side"), none_l.alias("_l"), "_r", "_b"))
        by.append("_b")
    window = Window.partitionBy(*by).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    both = ours.unionByName(theirs)
    found = F.when(usable, F.last("_r", ignorenulls=True).over(window))
    out = both.withColumn("_found", found).filter("_side = 1")
    if how == "inner":
        out = out.filter(F.col("_found").isNotNull())
    elif how != "left":
        raise ValueError("an as-of join is inner or left")
    return out.select("_l.*", F.col("_found").alias(alias))


def _bucket(df: DataFrame, size: str) -> Column:
    """The number of the bucket of ``_t``, null for a null time."""
    literal = "TIMESTAMP_NTZ" if dict(df.dtypes)["_t"] == "timestamp_ntz" else "TIMESTAMP"
    return F.expr(f"floor(timestampdiff(SECOND, {literal} '1970-01-01 00:00:00', `_t`) / {duration(size)})")


def versions(history: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """``history`` with _valid_from and _valid_to (null: until now); one version for each key and time."""
    latest = history.filter(F.col(f"`{time}`").isNotNull()).groupBy(*keys, time).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in history.columns])).alias("_v")).select("_v.*")
    w = Window.partitionBy(*keys).orderBy(time)
    return latest.withColumn("_valid_from", F.col(f"`{time}`")).withColumn("_valid_to", F.lead(f"`{time}`").over(w))


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], left_time: str, right_time: str, lower: float, upper: float, how: str = "inner") -> DataFrame:
    """Rows with equal keys and ``right_time`` between ``left_time + lower`` and ``left_time + upper`` seconds.

    The time line is cut in bins as wide as the interval. A left row goes to the bins
    that its interval touches (two or three at most), a right row to one, and the bin is part of
    the join key, so a task compares only rows that are near in time: the range
    condition alone would compare all pairs of a key. Columns keep their names; those on
    both sides must differ.
    """
    low, high = float(lower), float(upper)
    if high < low:
        raise ValueError("the interval is empty")
    width = max(high - low, 1e-6)
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    first, last = (F.floor((seconds(left_time) + x) / width) for x in (low, high))
    # a left row goes to each bin its interval touches; one without a time goes to none that matches
    slots = F.when(first.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(first, last))
    numbered = left.withColumn("_row", F.monotonically_increasing_id()) if how == "left" else left
    tried = numbered.withColumn("_slot", F.explode(slots))
    binned = right.withColumn("_bin", F.floor(seconds(right_time) / width))
    condition: Column = F.col("_slot") == F.col("_bin")
    for x, y in on:
        condition = condition & (F.col(x) == F.col(y))
    apart = seconds(right_time) - seconds(left_time)
    condition = condition & (apart >= low) & (apart <= high)
    if how == "inner":
        return tried.join(binned, condition).drop("_slot", "_bin")
    if how != "left":
        raise ValueError("an interval join is inner or left")
    joined = tried.join(binned, condition, "left")
    # of a row that found partners, its empty bins go; of one that found none, all but the first go
    w = Window.partitionBy("_row")
    hits = F.count("_bin").over(w)
    place = F.row_number().over(w.orderBy(F.col("_bin").isNull(), "_slot"))
    kept = joined.withColumn("_hits", hits).withColumn("_place", place).filter("_bin IS NOT NULL OR (_hits = 0 AND _place = 1)")
    return kept.drop("_row", "_slot", "_bin", "_hits", "_place")


#: Rows of a key in one part, at most about, when the pairs of large keys are dealt out.
HEAVY = 2000


def full_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], names: tuple[str, str], deal: Callable[[DataFrame, Sequence[str]], DataFrame] = lambda df, keys: df.repartition(*keys)) -> DataFrame:
    """The full outer join by equal keys as two struct columns ``names``, a null struct where a side has no row.

    Spark puts all pairs of a key in one task and can't split a full join. Here rows of ``left`` whose key has more than
    `HEAVY` are dealt out in parts, and the key's rows of ``right`` go to each part: at most one copy for `HEAVY` rows that come out.
    Rows of ``right`` whose key is not on the left are added by an anti join. ``deal`` puts rows with equal keys together.
    ``left`` is read twice and must give the same keys each time.
    """
    ours, theirs = [f"_a{i}" for i in range(len(on))], [f"_b{i}" for i in range(len(on))]
    kinds = [left.select(F.col(f"`{a}`")).crossJoin(right.select(F.col(f"`{b}`").alias("_b"))).selectExpr(f"coalesce(`{a}`, _b)").schema[0].dataType for a, b in on]
    row = lambda d: F.struct(*[F.col(f"`{c}`") for c in d.columns])
    a = left.select(row(left).alias("_l"), *[F.col(f"`{x}`").cast(t).alias(k) for (x, _), k, t in zip(on, ours, kinds, strict=True)])
    b = right.select(row(right).alias("_r"), *[F.col(f"`{y}`").cast(t).alias(k) for (_, y), k, t in zip(on, theirs, kinds, strict=True)])
    large = a.groupBy(*ours).count().filter(F.col("count") > HEAVY).select(*[F.col(k).alias(f"_h{k}") for k in ours], F.ceil(F.col("count") / HEAVY).alias("_parts"))

    def same(x: Sequence[str], y: Sequence[str]) -> Column:
        out = F.col(x[0]) == F.col(y[0])
        for p, q in zip(x[1:], y[1:], strict=True):
            out = out & (F.col(p) == F.col(q))
        return out

    of = [f"_h{k}" for k in ours]
    parts = F.coalesce("_parts", F.lit(1))
    dealt = a.join(F.broadcast(large), same(ours, of), "left").withColumn("_p", F.pmod(F.monotonically_increasing_id(), parts)).select("_l", *ours, "_p")
    copied = b.join(F.broadcast(large), same(theirs, of), "left").withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select("_r", *theirs, "_q")
    found = deal(dealt, [*ours, "_p"]).join(deal(copied, [*theirs, "_q"]), same([*ours, "_p"], [*theirs, "_q"]), "left").select("_l", "_r")
    alone = b.join(a.select(*ours).distinct(), same(theirs, ours), "left_anti")
    return found.unionByName(alone.select(F.lit(None).cast(found.schema["_l"].dataType).alias("_l"), "_r")).toDF(*names)
