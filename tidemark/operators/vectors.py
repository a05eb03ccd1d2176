"""Vectors as arrays: element-wise means and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.registry import TRANSLATIONS


def center(df: DataFrame, by: Sequence[str], vector: str, dim: int | None = None, name: str = "center") -> DataFrame:
    """The element-wise mean of each group.

    With ``dim`` each element is a partial aggregate, and vectors don't leave their task.
    Else elements are averaged by place; a shorter vector has no say in later places.
    """
    if dim is not None:
        return df.groupBy(*by).agg(F.expr(TRANSLATIONS["CENTER"](f"`{vector}`", str(dim))).alias(name))
    each = df.select(*by, F.posexplode(vector).alias("_at", "_x")).groupBy(*by, "_at").agg(F.avg("_x").alias("_x"))
    pairs = F.array_sort(F.collect_list(F.struct("_at", "_x")))
    return each.groupBy(*by).agg(F.transform(pairs, lambda p: p["_x"]).alias(name))


def similarity(vector: str | Column, query: Sequence[float]) -> Column:
    c = F.col(vector) if isinstance(vector, str) else vector
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(c.cast("array<double>"), q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(c.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return dot / (norm * F.lit(sum(float(x) ** 2 for x in query) ** 0.5))


def nearest(df: DataFrame, vector: str, query: Sequence[float], k: int, ties: str) -> DataFrame:
    """The ``k`` rows most similar to ``query`` by cosine: a scan, and a top-k that each task cuts before the merge."""
    return df.withColumn("similarity", similarity(vector, query)).orderBy(F.desc("similarity"), ties).limit(k)


def _units(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows scaled to length 1; vectors of another dimension or with a null, and zero vectors, have no similarity."""
    out = np.full((len(vectors), dim), np.nan)
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(sizes == dim)
    if len(fits) and dim:
        flat = vectors.take(pa.array(fits)).flatten()
        out[fits] = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(fits), dim)
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.sqrt((out * out).sum(1, keepdims=True))


#: Rows that are held against a block of queries at once.
SLICE = 1024


class _Best:
    """The best ``k`` rows of each query so far; of equal ones those with the smallest ids."""

    def __init__(self, wanted: np.ndarray, k: int):
        self.wanted, self.k = wanted, k
        self.sims, self.ids = np.full((len(wanted), k), -np.inf), np.full((len(wanted), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, units: np.ndarray) -> None:
        """Products of matrices find the candidates; each is then computed alone, so that equal vectors are equally similar wherever they lie."""
        rough = np.nan_to_num(self.wanted @ units.T, nan=-np.inf, copy=False)
        least = np.maximum(self.sims.min(1), np.partition(rough, len(ids) - min(self.k, len(ids)), axis=1)[:, len(ids) - min(self.k, len(ids))] if len(ids) >= self.k else -np.inf)
        with np.errstate(invalid="ignore"):
            q, at = np.nonzero((rough >= (least - 1e-9)[:, None]) & (rough > -np.inf))
        for start in range(0, len(q), 65536):
            self._merge(q[start : start + 65536], at[start : start + 65536], ids, units)

    def _merge(self, q: np.ndarray, at: np.ndarray, ids: np.ndarray, units: np.ndarray) -> None:
        sims = (self.wanted[q] * units[at]).sum(1)
        asked = np.unique(q)
        every_q = np.concatenate([np.repeat(asked, self.k), q])
        every_s, every_i = np.concatenate([self.sims[asked].ravel(), sims]), np.concatenate([self.ids[asked].ravel(), ids[at]])
        order = np.lexsort((every_i, -every_s, every_q))
        first = np.searchsorted(every_q[order], asked)
        best = order[first[:, None] + np.arange(self.k)]
        self.sims[asked], self.ids[asked] = every_s[best], every_i[best]


def nearest_each(df: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, block: int = 1024) -> DataFrame:
    """(query, id, similarity, place): for each row of ``queries`` the ``k`` rows of ``df`` most similar by cosine, exactly; equal ones by id.

    Queries are held against all rows in blocks of ``block``, which bounds what is sent to executors at once, and a task holds
    a block against `SLICE` rows at a time. Only a query's best ``k`` leave a task, and the rest is a top-k by query.
    """
    rows = df.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    ddl = "query long, id long, similarity double"
    found = None
    for part in batched(queries.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL").toLocalIterator(), block):
        dim = len(part[0]["v"])
        sent = df.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in part]), _units(pa.array([r["v"] for r in part], pa.list_(pa.float64())), dim)))

        def best(source: Iterator[pa.RecordBatch], sent=sent, dim=dim) -> Iterator[pa.RecordBatch]:
            names, wanted = sent.value
            found = _Best(wanted, k)
            for batch in source:
                for start in range(0, batch.num_rows, SLICE):
                    piece = batch.slice(start, SLICE)
                    found.add(piece.column(0).to_numpy(), _units(piece.column(1), dim))
            for start in range(0, len(names), SLICE):
                q, at = np.nonzero(found.sims[start : start + SLICE] > -np.inf)
                yield pa.RecordBatch.from_pydict({"query": pa.array(names[start + q]), "id": pa.array(found.ids[start + q, at]), "similarity": pa.array(found.sims[start + q, at])})

        some = rows.mapInArrow(best, ddl)
        found = some if found is None else found.union(some)
    if found is None:
        found = df.sparkSession.createDataFrame([], ddl)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)
