import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.registry import TRANSLATIONS
from tidemark.operators.dedup import changelog, distinct_on, filtered_distinct, updates
from tidemark.operators.joins import asof_join, interval_join, versions
from tidemark.operators.match import match_recognize
from tidemark.operators.paging import page
from tidemark.operators.upsert import StateTable, expired, merged, partition_width, pk_hash
from tidemark.operators.vectors import center, nearest, nearest_each
from tidemark.plans.cost import Node, shares_scan, stage
from tidemark.sources.connectors import Connector
from tidemark.sources.discovery import avro_schema, files_format

DAY = dt.datetime(2024, 1, 1)


def at(s):
    return DAY + dt.timedelta(seconds=s)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(6)
    left = [(i, rng.choice([1, 2, 3, None]), at(rng.randrange(0, 200_000)) if i % 17 else None) for i in range(300)]
    right = [(i, rng.choice([1, 2, 4, None]), at(rng.randrange(0, 200_000)) if i % 13 else None, i % 5) for i in range(200)]
    return left, right, spark.createDataFrame(left, "id long, k int, t timestamp_ntz"), spark.createDataFrame(right, "vid long, vk int, vt timestamp_ntz, x long")


@pytest.mark.parametrize("bucket", [None, "1 hour", "1 day"])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_asof_join_matches_brute_force(sides, bucket, how):
    left, right, a, b = sides
    want = []
    for i, k, t in left:
        fits = [r for r in right if None not in (k, t, r[2]) and r[1] == k and r[2] <= t]
        if fits:
            want.append((i, max((r[2], r[0]) for r in fits)[1]))
        elif how == "left":
            want.append((i, None))
    got = asof_join(a, b, [("k", "vk")], "t", "vt", "v", how, bucket).select("id", "v.vid").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_asof_join_is_one_shuffle_without_a_join(sides):
    _, _, a, b = sides
    plan = asof_join(a, b, [("k", "vk")], "t", "vt", "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_versions(sides):
    v = versions(sides[3], ["vk"], "vt").filter("vk = 1").orderBy("vt").collect()
    assert all(x["_valid_to"] == y["_valid_from"] for x, y in zip(v, v[1:], strict=False)) and v[-1]["_valid_to"] is None


@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join_matches_brute_force(sides, how):
    left, right, a, b = sides
    want = []
    for i, k, t in left:
        fits = [r[0] for r in right if None not in (k, t, r[2]) and r[1] == k and -600 <= (r[2] - t).total_seconds() <= 5400]
        want += [(i, f) for f in fits] or ([(i, None)] if how == "left" else [])
    got = interval_join(a, b, [("k", "vk")], "t", "vt", -600, 5400, how)
    assert sorted((tuple(r) for r in got.select("id", "vid").collect()), key=str) == sorted(want, key=str)


def test_distinct_on(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, None, "c"), (2, None, "d"), (None, 1, "e"), (None, 2, "f")], "k int, t int, v string")
    of = lambda *order: sorted(r["v"] for r in distinct_on(df, ["k"], list(order)).collect())
    assert of(("t", True, None)) == ["b", "d", "f"]
    assert of(("t", False, None)) == ["c", "d", "e"]
    assert of(("t", False, True)) == ["a", "d", "e"]
    assert of(("t", True, False)) == ["c", "d", "f"]
    assert of(("t", True, True), ("v", False, None)) == ["b", "d", "f"]
    assert distinct_on(df.limit(0), ["k"], [("t", True, None)]).count() == 0


def test_latest_row_is_combined_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS t")
    plan = distinct_on(df, ["k"], [("t", True, None)])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan


def test_filtered_distinct_keeps_the_row_that_last_changed_something(spark):
    rows = [(1, 10, 1, "a"), (1, 20, 2, "b"), (1, 30, 3, "b"), (1, 25, 4, "z"), (2, 5, 1, None), (2, 6, 2, None)]
    df = spark.createDataFrame(rows, "k int, o int, t int, v string")
    got = {r["k"]: (r["o"], r["v"]) for r in filtered_distinct(df, ["k"], "o", "t").collect()}
    assert got == {1: (20, "b"), 2: (5, None)}  # o = 30 changed nothing; o = 25 is below 30
    with pytest.raises(ValueError):
        filtered_distinct(df.withColumn("s", F.struct("v")), ["k"], "o")


def test_changes(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 1.0), ("a", 3, 2.0)], "k string, n int, x double")
    assert [tuple(r) for r in changelog(df, ["k"], ["n"], {"s": F.sum("x")}).orderBy("n").collect()] == [("a", 1, 5.0), ("b", 2, 1.0), ("a", 3, 7.0)]
    late = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1)], "k string, n int")
    assert sorted(tuple(r) for r in updates(late, ["k"], "n").collect()) == [("a", 1, "+I"), ("a", 3, "+U"), ("b", 1, "+I")]


def test_merge_modes(spark):
    s = "k int, v string, t int"
    now, new = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], s), spark.createDataFrame([(1, "x", 3), (2, "y", 9), (3, "z", 1)], s)
    of = lambda mode: sorted(r["v"] for r in merged(now, new, ["k"], mode, "t").collect())
    assert of("newer") == ["a", "y", "z"] and of("ignore") == ["a", "b", "z"] and of("overwrite") == ["x", "y", "z"]


def test_sink_keys(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert pk_hash(df, []).select("__pk_hash").distinct().count() == 1
    assert pk_hash(df, None).select("__pk_hash").distinct().count() == 2
    assert pk_hash(df, ["b"]).select("__pk_hash").distinct().count() == 2


def test_retention(spark):
    df = spark.createDataFrame([(at(0),), (at(100),)], "t timestamp_ntz")
    assert expired(df, "t", 60, F.lit(at(120))).count() == 1
    assert partition_width(86400 * 30) == "day" and partition_width(100) == "hour" and partition_width(86400 * 3650) == "year"


def test_match_recognize(spark):
    prices = [("a", i, p) for i, p in enumerate([10, 8, 6, 7, 9, 9, 5, 6])] + [("b", i, p) for i, p in enumerate([1, 2, 3])]
    df = spark.createDataFrame(prices, "s string, i int, p int")
    out = match_recognize(df, ["s"], ["i"], "START DOWN+ UP+", {"DOWN": "p < PREV(p)", "UP": "p > PREV(p)"}).orderBy("match_number", "i").collect()
    assert [(r["match_number"], r["i"], r["matched_symbol"]) for r in out] == [(1, 0, "START"), (1, 1, "DOWN"), (1, 2, "DOWN"), (1, 3, "UP"), (1, 4, "UP"), (2, 5, "START"), (2, 6, "DOWN"), (2, 7, "UP")]
    with pytest.raises(ValueError):
        match_recognize(df, ["s"], ["i"], "A B C D E F G H I", {})


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 4.0])], "k int, v array<double>")
    for dim in (None, 2):
        assert {r["k"]: r["center"] for r in center(df, ["k"], "v", dim).collect()} == {1: [0.5, 0.5], 2: [3.0, 4.0]}
    assert [r["k"] for r in nearest(df, "v", [0.6, 0.8], 1, "k").collect()] == [2]


def test_pages(spark):
    with pytest.raises(ValueError):
        page(spark.range(3), 0)
    assert page(spark.range(0), 5, fields=("totalRecords",)).totalRecords == 0


def test_cost_model():
    assert stage(Node("a", 100.0, 3)) == "table" and stage(Node("a", 1.0, 3)) == "view" and stage(Node("a", 100.0, 1)) == "view"
    assert stage(Node("a", 100.0, 3), "WRITE") == "view" and stage(Node("a", 1.0, 0, pinned="table")) == "table"
    assert shares_scan(12, 1 << 30) and not shares_scan(9, 1 << 30) and not shares_scan(5, None)


GOLDEN = [
    ("TRUNCATE", ["-2.97", "1"], -2.9), ("SPLIT_INDEX", ["'a|b|c'", "'|'", "2"], "c"), ("SPLIT_INDEX", ["'a'", "'|'", "5"], None), ("REGEXP_EXTRACT", ["'foo'", "'[0-9]'"], None), ("UNHEX", ["'41'"], "A"),
    ("ARRAY_SLICE", ["array(1, 2, 3, 4)", "2", "3"], [2, 3]), ("ARRAY_SLICE", ["array(1, 2, 3, 4)", "-2"], [3, 4]), ("ARRAY_SLICE", ["array(1, 2)", "3", "1"], []), ("ARRAY_REMOVE", ["array(1, NULL, 2)", "NULL"], [1, 2]),
    ("ARRAY_SORT", ["array(2, NULL, 1)"], [None, 1, 2]), ("ARRAY_SORT", ["array(2, NULL, 1)", "FALSE"], [2, 1, None]), ("ARRAY_SORT", ["array(2, NULL, 1)", "TRUE", "FALSE"], [1, 2, None]), ("ELEMENT", ["array(7)"], 7),
    ("JSON_QUOTE", ["'a\"b'"], '"a\\"b"'), ("JSON_UNQUOTE", ["'\"ab\"'"], "ab"), ("IS_JSON", ["'{'"], False), ("IS_DECIMAL", ["'-1.5'"], True), ("IS_ALPHA", ["'a1'"], False), ("STR_TO_MAP", ["'k=v,x=y'"], {"k": "v", "x": "y"}),
    ("EXPONENTIAL_DISTRIBUTION", ["1D", "1D"], 0.6321205588), ("COPY_SIGN", ["3", "-0.0D"], -3.0), ("COSINE_SIMILARITY", ["array(1, 0)", "array(0, 2)"], 0.0), ("EUCLIDEAN_DISTANCE", ["array(0, 0)", "array(3, 4)"], 5.0),
    ("JSONB_EXTRACT", ["parse_json('{\"a\": 1}')", "'$.a'"], "1"), ("JSONB_EXTRACT", ["parse_json('{\"a\": 1}')", "'$.a'", "100"], 1), ("JSONB_EXTRACT", ["parse_json('{\"a\": 1}')", "'$.b'", "100"], 100), ("JSONB_EXTRACT", ["parse_json('{\"a\": 1}')", "'$.b'"], None),
    ("CONVERT_TZ", ["'2024-01-01 00:00:00'", "'UTC'", "'Asia/Tokyo'"], "2024-01-01 09:00:00"), ("TO_DATE", ["'nonsense'"], None), ("TEXT_SEARCH", ["'runs dogs'", "'The dog was running'"], None), ("SHA224", ["'a'"], "abd37534c7d9a2efb9465de931cd7055ffdb8879563ae98078d6d6d5"),
]


@pytest.mark.parametrize(("name", "args", "want"), GOLDEN, ids=[f"{n}{i}" for i, (n, _, _) in enumerate(GOLDEN)])
def test_functions(spark, name, args, want):
    got = spark.sql(f"SELECT {TRANSLATIONS[name](*args)} AS x").first()["x"]
    if name == "TEXT_SEARCH":
        assert got >= 0
    elif isinstance(want, float):
        assert got == pytest.approx(want)
    else:
        assert got == want


def test_avro():
    text = '{"type": "record", "name": "R", "fields": [{"name": "a", "type": ["null", "long"]}, {"name": "t", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "xs", "type": {"type": "array", "items": {"type": "record", "name": "X", "fields": [{"name": "q", "type": "double"}]}}}, {"name": "m", "type": {"type": "map", "values": "int"}}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["P"]}}]}'
    assert avro_schema(text).simpleString() == "struct<a:bigint,t:timestamp,xs:array<struct<q:double>>,m:map<string,int>,e:string>"
    for bad in ('{"type": "record", "name": "R", "fields": [{"name": "r", "type": ["null", "R"]}]}', '{"type": "record", "name": "R", "fields": [{"name": "r", "type": ["int", "string"]}]}'):
        with pytest.raises(ValueError):
            avro_schema(bad)


def test_connectors(spark, tmp_path):
    assert files_format("a.CSV.gz") == "csv"
    with pytest.raises(ValueError):
        files_format("a.xyz")
    schema = spark.createDataFrame([], "id long, name string, t timestamp").schema
    assert Connector({"connector": "datagen", "number-of-rows": "7"}).read(spark, schema).count() == 7
    out = Connector({"connector": "filesystem", "format": "csv", "path": str(tmp_path / "c")})
    out.write(spark.sql("SELECT 1 AS id, parse_json('{\"a\": 1}') AS j"), "overwrite")
    assert out.read(spark, None).first()["j"] == '{"a":1}'
    for options in ({"connector": "print"}, {"connector": "nothing"}, {"connector": "filesystem"}):
        with pytest.raises(ValueError):
            Connector(options).read(spark, schema)


def test_a_batch_of_one_key_rewrites_one_bucket(spark, tmp_path):
    schema = "k long, v string, t long"
    table = StateTable(spark, str(tmp_path / "s"), schema, ["k"], "newer", "t", buckets=8)
    table.write(spark.createDataFrame([(k, "a", 1) for k in range(100)], schema))
    before = table.versions()[1]
    table.write(spark.createDataFrame([(5, "b", 2), (5, "old", 0)], schema))
    after = table.versions()[1]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert sum(1 for _ in (tmp_path / "s" / "data" / "v1").glob("_bucket=*")) == 1
    assert {r["k"]: r["v"] for r in table.read().collect()} == {k: "b" if k == 5 else "a" for k in range(100)}
    for t in range(3, 6):
        table.write(spark.createDataFrame([(7, "c", t)], schema))
    assert table.read().count() == 100 and len(list((tmp_path / "s" / "lists").glob("[0-9]*"))) == 2
    again = StateTable(spark, str(tmp_path / "s"), schema, ["k"], "newer", "t", buckets=3)
    again.write(spark.createDataFrame([(7, "d", 9), (200, "new", 1)], schema))
    assert again.buckets == 8 and again.read().filter("k = 7 AND v = 'd'").count() == 1 and again.read().count() == 101
    again.write(spark.createDataFrame([], schema))
    assert again.read().count() == 101


def test_nearest_each_matches_all_pairs(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 8))
    vectors[10] = vectors[20] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 8), (902, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for block in (3, 1000):
        got = {}
        for r in nearest_each(df, df.filter("id % 50 = 0"), "id", "v", 5, block).collect():
            got.setdefault(r["query"], {})[r["place"]] = r["id"]
        for q in range(0, 300, 50):
            want = sorted(range(300), key=lambda i: (-round(float(unit[i] @ unit[q]), 12), i))[:5]
            assert [got[q][p] for p in range(1, 6)] == want
    assert nearest_each(df, df.limit(0), "id", "v", 5).count() == 0


def test_the_best_of_a_task_are_kept_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from tidemark.operators import vectors

    rng = np.random.default_rng(8)
    rows = np.round(rng.normal(size=(20_000, 8)), 1)
    rows[5_000:5_400] = rows[:400]  # copies in other slices: as similar, so the smaller id comes first
    ids = rng.permutation(len(rows)).astype(np.int64)
    wanted = vectors._units(pa.array(rows[:512].tolist(), pa.list_(pa.float64())), 8)
    batch = pa.array(rows.tolist(), pa.list_(pa.float64()))
    tracemalloc.start()
    found = vectors._Best(wanted, 5)
    for start in range(0, len(rows), vectors.SLICE):
        found.add(ids[start : start + vectors.SLICE], vectors._units(batch.slice(start, vectors.SLICE), 8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # all products at once are 82 MB
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for q in range(0, 512, 37):
        sims = (unit @ wanted[q]).round(12)
        want = np.lexsort((ids, -sims))[:5]
        assert found.ids[q].tolist() == ids[want].tolist() and np.allclose(found.sims[q], sims[want])


def jdbc(name, table, **more):
    return Connector({"connector": "jdbc", "url": f"jdbc:derby:memory:{name};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "table-name": table} | {k.replace("_", "-").replace("--", "."): v for k, v in more.items()})


@pytest.mark.parametrize(("mode", "want"), [("overwrite", {1: "old", 2: "b", 3: "new"}), ("newer", {1: "a", 2: "b", 3: "new"}), ("ignore", {1: "a", 2: "b", 3: "new"})])
def test_a_database_sink_upserts_by_key(spark, mode, want):
    sink = jdbc(f"up_{mode}", "state", sink__upsert_mode=mode)
    schema = "id long, v string, t long"
    sink.write(spark.createDataFrame([(1, "a", 5), (2, "b", 5)], schema), "overwrite")
    batch = spark.createDataFrame([(1, "older", 1), (1, "old", 2), (3, "new", 1)], schema)
    for _ in range(2):  # a repeated write changes nothing
        sink.write(batch, "append", keys=["id"], time="t")
    assert {r["id"]: r["v"] for r in sink.read(spark, None).collect()} == want


def test_a_database_table_is_read_in_ranges(spark):
    sink = jdbc("ranges", "numbers")
    sink.write(spark.range(100).withColumn("v", F.col("id") * 2), "overwrite")
    parts = jdbc("ranges", "numbers", scan__partition__column="id", scan__partition__num="4", scan__partition__lower_bound="0", scan__partition__upper_bound="100")
    df = parts.read(spark, None)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100 and df.agg(F.sum("v")).first()[0] == 9900
    with pytest.raises(ValueError, match="scan.partition"):
        jdbc("ranges", "numbers", scan__partition__column="id").read(spark, None)


def test_records_of_an_upserting_log(spark):
    at = dt.datetime(2024, 1, 1)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("at", T.TimestampType())])
    rows = spark.createDataFrame([(b'{"id": 1}', b'{"name": "a"}', at), (b'{"id": 2}', None, at), (None, None, at)], "key binary, value binary, timestamp timestamp")
    got = Connector({"connector": "upsert-kafka", "key.fields": "id", "timestamp-column": "at"}).records(rows, schema)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", at, False), (2, None, at, True)]
    assert [r["name"] for r in Connector({"connector": "kafka", "timestamp-column": "at"}).records(rows, schema).collect()] == ["a"]


def test_a_print_sink_gives_all_rows(spark, capfd):
    Connector({"connector": "print"}).write(spark.range(100).withColumn("v", F.lit(None).cast("string")))
    out = capfd.readouterr().out.splitlines()
    assert out[0] == "id | v" and len(out) == 101 and out[-1] == "99 | NULL"
