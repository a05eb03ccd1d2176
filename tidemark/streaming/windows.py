"""Windowed aggregation of streams. The batch forms give the same rows from the same expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _milli() -> Column:
    return F.expr("INTERVAL '0.001' SECOND")


def _named(df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    end = F.col("_w.end")
    return df.select(F.col("_w.start").alias("window_start"), end.alias("window_end"), (end - _milli()).alias("window_time"), *by, *names)


def tumble(df: DataFrame, time: str, size: str, by: Sequence[str], aggregates: dict[str, Column], offset: str | None = None) -> DataFrame:
    """``df`` should have a watermark on ``time``, so that closed windows leave the state."""
    window = F.window(time, size, size, offset) if offset else F.window(time, size)
    return _named(df.groupBy(window.alias("_w"), *by).agg(*[a.alias(n) for n, a in aggregates.items()]), by, list(aggregates))


def hop(df: DataFrame, time: str, slide: str, size: str, by: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    return _named(df.groupBy(F.window(time, size, slide).alias("_w"), *by).agg(*[a.alias(n) for n, a in aggregates.items()]), by, list(aggregates))


def cumulate(df: DataFrame, time: str, step: str, size: str, by: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Windows that grow by ``step`` up to ``size``. The window of the full size is the state's key, together with the end, so it is evicted as a whole."""
    w = F.window(time, size)
    ends = F.filter(F.sequence(w["start"] + F.expr(f"INTERVAL {step}"), w["end"], F.expr(f"INTERVAL {step}")), lambda e: e > F.col(time))
    grown = df.withColumn("_e", F.explode(ends))
    out = grown.groupBy(F.window(time, size).alias("_w"), "_e", *by).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(F.col("_w.start").alias("window_start"), F.col("_e").alias("window_end"), (F.col("_e") - _milli()).alias("window_time"), *by, *aggregates)


def session(df: DataFrame, time: str, gap: str, by: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    return _named(df.groupBy(F.session_window(time, gap).alias("_w"), *by).agg(*[a.alias(n) for n, a in aggregates.items()]), by, list(aggregates))


def first_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row of each key that arrives within the watermark: state is kept no longer than that."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))
