import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm.queries import QUERIES
from tidemark.llm.sharding import document_metadata, hilbert_index, hilbert_shards


@pytest.mark.parametrize(("n", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2), (2, 1)])
def test_curve_visits_every_cell_by_single_steps(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame([(list(c),) for c in cells], "bins array<int>")
    got = sorted(((r["i"], r["bins"]) for r in df.select("bins", hilbert_index([F.lit(0)] * n, bits).alias("i")).collect()))
    assert [i for i, _ in got] == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for (_, x), (_, y) in zip(got, got[1:], strict=False))


def check(got, rows, shards=16):
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op5_hilbert_shards"](spark, sf).collect()
    check(got, rows)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in order] == sorted(r["hilbert"] for r in got)


def test_shards_prune_in_every_dimension(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.rand(1) * 1000).alias("x"), (F.rand(2) * 1000).alias("y"))
    out = hilbert_shards(df, {"x": "number", "y": "number"})
    spans = out.groupBy("shard").agg((F.max("x") - F.min("x")).alias("x"), (F.max("y") - F.min("y")).alias("y")).collect()
    assert sum(r["x"] for r in spans) / 16 < 450 and sum(r["y"] for r in spans) / 16 < 450


@pytest.mark.parametrize("name", ["docs", "wide"])
def test_edge_cases(request, rows, empty, name):
    df = request.getfixturevalue(name)
    meta = document_metadata(df)
    got = hilbert_shards(meta, {"lang": "hash", "size": "number", "lines": "number"}, ties=("text_hash", "doc_id")).collect()
    check(got, [r[:2] for r in rows])
    assert hilbert_shards(document_metadata(empty), {"lang": "hash", "size": "number"}).count() == 0


def test_hot_cell_is_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(7).alias("x"))
    got = hilbert_shards(df, {"x": "number"}, ties=("doc_id",)).groupBy("shard").count().collect()
    assert len(got) == 16 and {r["count"] for r in got} <= {187, 188}
