"""Streams into tables of state, and state of one's own for each key."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.upsert import StateTable


def upsert(stream: DataFrame, table: StateTable, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write a stream of changes to ``table`` by key; a DISTINCT by time on a stream is this, its ranking left to the key."""
    writer = stream.writeStream.foreachBatch(table.for_each_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


#: Rows of a key that are sorted at once, and rows of a sorted run that are read at once.
RUN, BLOCK = 500_000, 25_000


def in_order(batches: Iterable[pd.DataFrame], time: str, run: int | None = None, block: int | None = None) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` by ``time``, those of equal times as they came, in frames of bounded size.

    Beyond ``run`` rows, sorted runs are written to a file of the task's own, which goes when it is closed, and merged; held at once
    are a run, or a block of each run.
    """
    run, block = run or RUN, block or BLOCK
    held: list[pd.DataFrame] = []
    rows = seen = 0

    def sort(frames: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(frames, ignore_index=True).sort_values([time, "_at"], ignore_index=True)

    # where the executor keeps its own blocks
    with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as file:
        places: list[tuple[int, int]] = []

        def write() -> None:
            done = sort(held)
            held.clear()
            start = file.tell()
            for i in range(0, len(done), block):
                pickle.dump(done.iloc[i : i + block].reset_index(drop=True), file)
            places.append((start, file.tell()))

        for batch in batches:
            for i in range(0, len(batch), run):
                held.append(batch.iloc[i : i + run].assign(_at=range(seen, seen + len(batch.iloc[i : i + run]))))
                seen, rows = seen + len(held[-1]), rows + len(held[-1])
                if rows >= run:
                    write()
                    rows = 0
        if not places:
            if held:
                done = sort(held)
                for i in range(0, len(done), block):
                    yield done.iloc[i : i + block].drop(columns="_at")
            return
        if held:
            write()
        at: list[int] = [start for start, _ in places]
        ends: list[int | None] = [None] * len(places)

        def load(i: int) -> pd.DataFrame | None:
            if at[i] >= places[i][1]:
                ends[i] = None
                return None
            file.seek(at[i])
            out = pickle.load(file)
            at[i] = file.tell()
            ends[i] = int(out["_at"].iloc[-1])
            return out

        pool = sort([load(i) for i in range(len(places))])
        while len(pool):
            # up to the first row after which a run has more rows that are not here
            order = pd.Series(pool.index, index=pool["_at"])
            cuts = {i: int(order[e]) for i, e in enumerate(ends) if e is not None}
            cut = min(cuts.values(), default=len(pool) - 1) + 1
            for i in range(0, cut, block):
                yield pool.iloc[i : min(i + block, cut)].drop(columns="_at")
            more = [f for i, place in cuts.items() if place < cut and (f := load(i)) is not None]
            pool = sort([pool.iloc[cut:], *more]) if more or cut < len(pool) else pool.iloc[:0]


def changelog(stream: DataFrame, key: str, value: str, time: str) -> DataFrame:
    """A running count and sum of ``value`` for each ``key``, a row (key, time, op, n, total) for each update.

    Rows of a micro-batch are taken in order of ``time``, in runs that are sorted on disk beyond `RUN` rows, so
    what is held doesn't grow with a key's rows. The state is two numbers for each key.
    """
    kinds = dict(stream.dtypes)
    schema = f"`{key}` {kinds[key]}, `{time}` {kinds[time]}, op string, n long, total double"

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for rows in in_order((b[[value, time]] for b in batches), time):
            counts = n + np.arange(1, len(rows) + 1)
            totals = total + rows[value].astype(float).fillna(0.0).cumsum().to_numpy()
            n, total = int(counts[-1]), float(totals[-1])
            yield pd.DataFrame({key: k[0], time: rows[time].to_numpy(), "op": np.where(counts == 1, "+I", "+U"), "n": counts, "total": totals})
        state.update((n, total))

    return stream.groupBy(key).applyInPandasWithState(update, schema, "n long, total double", "append", GroupStateTimeout.NoTimeout)
