"""Joins of streams with streams, and of streams with versioned tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import asof_join


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], left_time: str, right_time: str, lower: str, upper: str, how: str = "inner") -> DataFrame:
    """Two watermarked streams: ``right_time`` lies between ``left_time + lower`` and ``left_time + upper`` (such as ``0 minutes``).

    The bound lets Spark drop rows from the state that no later row can reach.
    """
    condition = (F.col(right_time) >= F.col(left_time) + F.expr(f"INTERVAL {lower}")) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {upper}"))
    for a, b in on:
        condition = condition & (F.col(a) == F.col(b))
    return left.join(right, condition, {"inner": "inner", "left": "leftOuter", "right": "rightOuter"}[how])


def temporal_join_batches(versions: Callable[[], DataFrame], on: Sequence[tuple[str, str]], left_time: str, right_time: str, alias: str, sink: Callable[[DataFrame, int], None], how: str = "inner") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: each micro-batch is joined as of its times with the versions known then.

    ``versions`` reads the version history anew for each batch. A version that arrives after a row it would have
    applied to doesn't change that row.
    """

    def run(batch: DataFrame, number: int) -> None:
        sink(asof_join(batch, versions(), on, left_time, right_time, alias, how), number)

    return run
