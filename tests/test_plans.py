"""Physical plans: what reaches the scan, what is shuffled, and that nothing leaves the JVM."""

import re

import pytest

from tidemark.plans.catalog import engine
from tidemark.plans.catalog_more import QUERIES
from tidemark.plans.engine import Engine
from tidemark.plans.table_type import TableType

#: Queries that need Python by nature.
PYTHON = {"match_recognize", "fn_distributions", "vector_nearest", "user_function"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - PYTHON - {"page_info"} if not n.startswith("stream_")))
def test_no_python_and_no_cartesian_product_of_tables(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert not re.search("BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow|FlatMapGroups", text)
    if name not in ("join_cross", "vector_similarity"):
        assert "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["filter_project"](spark, sf))
    scan = next(x for x in text.split("\n") if "FileScan" in x)
    assert "GreaterThan(l_quantity,30.0)" in scan and "GreaterThanOrEqual(l_shipdate" in scan
    assert "l_returnflag" not in scan.split("ReadSchema")[1]


def test_a_filter_on_a_definition_reaches_the_scan_through_windows_by_its_key(spark, sf):
    e = engine(spark, sf, "L := SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS rn FROM orders; R := SELECT o_orderkey FROM L WHERE rn = 1 AND o_custkey = 7;")
    assert "EqualTo(o_custkey,7)" in plan(e.query("R"))


@pytest.mark.parametrize(("name", "most"), [("filter_project", 0), ("group_agg", 1), ("distinct_latest", 1), ("temporal_join_left", 1), ("running_sum", 1), ("tumble", 1), ("cumulate", 1), ("topk", 0), ("changelog_aggregate", 1), ("array_agg", 1), ("session", 1), ("to_changelog", 1)])
def test_shuffles(spark, sf, name, most):
    assert len(re.findall(r"\bExchange (?:hash|range|single)", plan(QUERIES[name](spark, sf)))) <= most


def test_aggregates_are_combined_before_the_shuffle(spark, sf):
    for name in ("group_agg", "tumble", "hop", "distinct_latest", "count_distinct", "tpch_q1"):
        assert "partial_" in plan(QUERIES[name](spark, sf))


def test_ranks_are_cut_in_each_task(spark, sf):
    assert "WindowGroupLimit" in plan(QUERIES["distinct_asc"](spark, sf))


def test_relationships_become_plain_joins(spark, sf):
    text = QUERIES["relationship"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "LateralJoin" not in text and "Join Inner" in text


def test_interval_joins_have_an_equality_besides_the_key(spark, sf):
    text = plan(QUERIES["interval_join"](spark, sf))
    assert re.search(r"Join \[user_id#\d+L?, _slot|Join \[_slot|\[_slot#\d+L?, user_id", text)


def test_temporal_joins_read_the_columns_that_are_named(spark, sf):
    e = engine(spark, sf, "V := DISTINCT orders ON o_custkey ORDER BY o_orderdate DESC; R := SELECT l.o_orderkey, v.o_totalprice FROM orders l JOIN V FOR SYSTEM_TIME AS OF l.o_orderdate v ON l.o_custkey = v.o_custkey;")
    scans = [x.split("ReadSchema")[1] for x in plan(e.query("R")).split("\n") if "FileScan" in x]
    assert len(scans) == 2 and all("o_orderpriority" not in x and "o_orderstatus" not in x for x in scans)


@pytest.mark.parametrize(
    "query",
    [
        "SELECT a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL '10' MINUTE AND a.ts + INTERVAL '5' MINUTE",
        "SELECT * FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL '30' MINUTE",
        "SELECT a.*, b.event_id AS other FROM events a INNER JOIN events AS b ON a.ts - INTERVAL '1' HOUR < b.ts AND a.ts > b.ts WHERE a.value > 100",
        "SELECT count(*) AS n, b.user_id FROM events a LEFT OUTER JOIN events b ON b.ts + INTERVAL '1' HOUR >= a.ts AND b.ts <= a.ts AND a.user_id = b.user_id GROUP BY b.user_id",
    ],
)
def test_interval_joins_of_scripts_are_binned_and_give_the_same(spark, sf, query):
    e = engine(spark, sf, f"R := {query};")
    assert re.search(r"\[.*_bin_\d+_\d+_l", plan(e.query("R"))) and not re.search("NestedLoop|Cartesian", plan(e.query("R")))
    want = spark.sql(query)
    assert e.query("R").columns == e._unique(want.columns)
    assert sorted(map(tuple, e.query("R").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("query", ["SELECT a.event_id FROM events a JOIN events b ON b.ts > a.ts AND a.user_id = b.user_id", "SELECT a.event_id FROM events a FULL JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL '1' HOUR", "SELECT a.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND (b.ts > a.ts OR b.ts < a.ts + INTERVAL '1' DAY)"])
def test_other_joins_are_left_as_they_are(spark, sf, query):
    assert "_bin_" not in plan(engine(spark, sf, f"R := {query};").query("R"))


@pytest.mark.parametrize("select", ["*", "l.*, v.o_totalprice AS price", "l.o_orderkey, v.*", "l.o_orderkey, v.o_totalprice"])
def test_temporal_joins_of_scripts_compare_no_ranges(spark, sf, select):
    text = f"V := DISTINCT orders ON o_custkey ORDER BY o_orderdate DESC; R := SELECT {select} FROM orders l LEFT JOIN V FOR SYSTEM_TIME AS OF l.o_orderdate v ON l.o_custkey = v.o_custkey;"
    e = engine(spark, sf, text)
    assert "Join" not in plan(e.query("R")) and not any(c.startswith(("_valid", "v0")) or c == "v" for c in e.query("R").columns)
    want = {"*": 12, "l.*, v.o_totalprice AS price": 7, "l.o_orderkey, v.*": 7, "l.o_orderkey, v.o_totalprice": 2}[select]
    assert len(e.query("R").columns) == want and e.query("R").count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_temporal_joins_of_scripts_can_cut_hot_keys_over_time(spark, sf):
    text = "V := DISTINCT orders ON o_custkey ORDER BY o_orderdate DESC; R := SELECT l.o_orderkey, v.o_totalprice FROM orders l JOIN V FOR SYSTEM_TIME AS OF l.o_orderdate v ON l.o_custkey = v.o_custkey;"
    rows = []
    for bucket in (None, "30 day"):
        e = Engine(spark, asof_bucket=bucket)
        e.register("orders", spark.read.parquet(f"{sf}/orders.parquet"), TableType.STREAM, ["o_orderkey"], "o_orderdate")
        df = e.run(text).query("R")
        assert ("_b#" in plan(df)) == (bucket is not None)
        rows.append(sorted(map(tuple, df.collect())))
    assert rows[0] == rows[1]


@pytest.mark.parametrize("spread", [False, True])
@pytest.mark.parametrize(
    "query",
    [
        "SELECT a.id, b.id AS other FROM a JOIN b ON b.x > a.x AND b.x < a.x + 40",
        "SELECT * FROM a LEFT JOIN b ON b.x BETWEEN a.x - 0.5 AND a.x + 2",
        "SELECT a.*, b.d FROM b JOIN a ON a.n + 3 >= b.n AND a.n - 2 < b.n WHERE a.id > 5",
        "SELECT a.id, b.id AS other FROM a LEFT JOIN b ON a.d - 0.25 <= b.d AND a.d + 0.25 >= b.d AND a.id % 7 = b.id % 7",
        "SELECT a.id, b.id AS other FROM a JOIN b ON b.x >= a.x AND b.x <= a.x + 0.1",
    ],
)
def test_joins_by_a_range_of_numbers_are_binned_and_give_the_same(spark, monkeypatch, query, spread):
    from tidemark.plans import engine as module

    monkeypatch.setattr(module, "SPREAD", 0 if spread else 1 << 40)
    rows = spark.sql("SELECT id, CAST(pmod(id * 7919, 2003) AS DOUBLE) / 10 AS x, pmod(id * 31, 97) AS n, CAST(pmod(id, 50) AS DECIMAL(9, 2)) / 4 AS d FROM range(300)")
    odd = spark.sql("SELECT id, x, n, d FROM VALUES (1000L, double('NaN'), null, null), (1001L, double('Infinity'), 9223372036854775L, null), (1002L, null, -9L, 1.25), (1003L, 1e17D, 0L, -0.25), (1004L, -1e300D, 9223372036854776L, 0.0) AS t(id, x, n, d)")
    a, b = rows.union(odd), rows.filter("id % 3 = 0").union(odd)
    a.createOrReplaceTempView("a")
    b.createOrReplaceTempView("b")
    e = Engine(spark, tables={"a": a, "b": b}).run(f"R := {query};")
    text = plan(e.query("R"))
    assert re.search(r"\[.*_bin_\d+_\d+_l", text) and not re.search("NestedLoop|Cartesian", text)
    assert ("REPARTITION_BY_NUM" in text) == (spread and "%" not in query)
    want = spark.sql(query)
    got = sorted(str(tuple(r)) for r in e.query("R").collect())  # as text, since NaN is not itself
    assert got == sorted(str(tuple(r)) for r in want.collect()) and len(got) > 100


def test_the_range_join_of_the_catalogue_compares_no_pairs_of_tables(spark, sf):
    text = plan(QUERIES["join_range"](spark, sf))
    assert "_bin_" in text and not re.search("NestedLoop|Cartesian", text)


@pytest.mark.parametrize(
    ("query", "dealt"),
    [
        ("SELECT x.id, y.id AS other FROM (SELECT id, k FROM a WHERE id <> 3) x FULL JOIN b AS y ON x.k = y.k", True),
        ("SELECT y.*, x.id AS other FROM b y FULL OUTER JOIN a x ON y.k = x.k AND y.m = x.m WHERE x.id IS NULL OR x.id > 5", True),
        ("SELECT y.k, count(*) AS n, count(x.id) AS xs FROM b y FULL JOIN (SELECT * FROM a) x ON y.k = x.k GROUP BY y.k", True),
        ("SELECT * FROM a x FULL JOIN b y ON x.k = y.k", False),
        ("SELECT x.id, y.id AS other FROM a x FULL JOIN b y ON x.k = y.k AND x.id < y.id", False),
        ("SELECT x.id, y.id AS other FROM (SELECT id, k FROM a ORDER BY id LIMIT 50) x FULL JOIN b y ON x.k = y.k", False),
    ],
)
def test_full_joins_deal_out_large_keys_and_give_the_same(spark, monkeypatch, query, dealt):
    from tidemark.operators import joins
    from tidemark.plans import engine as module

    monkeypatch.setattr(module, "SPREAD", 0)
    monkeypatch.setattr(joins, "HEAVY", 10)
    a = spark.sql("SELECT id, IF(id % 10 = 0, null, IF(id < 200, 1, CAST(id % 7 AS INT))) AS k, id % 2 AS m FROM range(300) UNION ALL SELECT 7L, 99, 0L")
    b = spark.sql("SELECT id, IF(id % 9 = 0, null, IF(id < 20, 1L, id % 11)) AS k, id % 2 AS m FROM range(60)")
    a.createOrReplaceTempView("a")
    b.createOrReplaceTempView("b")
    e = Engine(spark, tables={"a": a, "b": b}).run(f"R := {query};")
    text = plan(e.query("R"))
    assert ("REPARTITION_BY_NUM" in text) == dealt and ("FullOuter" in text) != dealt
    want = spark.sql(query)
    assert e.query("R").columns == e._unique(want.columns)
    assert sorted(map(tuple, e.query("R").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
