import random

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm.packing import PIECES
from .conftest import SCHEMA, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with planted cases; returns the folder and what should become of them."""
    rng = random.Random(21)
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(i, " ".join(f"q{rng.randrange(9999)}" for _ in range(60))) for i in range(5)]
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(4000)}"
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n // 12))
    rows, passage = [], text(72)
    rows += [(i, text(240)) for i in range(30)]  # clean
    rows += [(100, rows[3][1]), (101, rows[4][1].replace(rows[4][1].split()[50], "changed", 1))]  # exact and near copy, in line-aligned form
    near = rows[5][1].replace("\n", " ")
    rows += [(102, near), (103, " ".join([*near.split()[:100], "changed", *near.split()[101:]]))]
    rows += [(110, text(72) + "\n" + passage + "\n" + text(72)), (111, text(96) + "\n" + passage + "\n" + text(96))]
    rows += [(120, text(72) + "\n" + items[2][1] + "\n" + text(72))]
    rows += [(130, "too short"), (131, None), (132, "spam ham eggs " * 100)]
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows), passage, items


def test_stages_take_effect_and_clean_documents_stay(spark, tables):
    folder, before, passage, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    after = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == columns
            docs.write.parquet(f"{folder}/stage{k}")
            docs = spark.read.parquet(f"{folder}/stage{k}")
            after[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not {130, 131, 132} & set(after["quality_rules"]) and len(after["quality_rules"]) == len(before) - 3
    lines = after["line_dedup"]
    assert passage in lines[110] and passage.split("\n")[2] not in lines[111] and 100 not in lines
    assert (102 in after["near_dedup"] or 5 in after["near_dedup"]) and 103 not in after["near_dedup"]
    assert 120 in after["near_dedup"] and 120 not in after["decontamination"]
    for i in range(30):
        assert after["decontamination"][i] == before[i]
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == set(after["decontamination"])
    assert [f"{n} {t}" for n, t in docs.dtypes] == [x.strip().replace("long", "bigint") for x in PIECES.split(",")]


def test_run_on_the_tables(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    kept = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    every = {r[0] for r in duckdb.execute(f"SELECT doc_id FROM '{sf}/documents.parquet'").fetchall()}
    assert kept < every and len(kept) > 0.4 * len(every)


def test_empty_documents(spark, tables, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_prose_is_kept(spark, tmp_path):
    rng = random.Random(1)
    spark.createDataFrame([(i, prose(rng, 150), "en", "s", None) for i in range(40)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 40
