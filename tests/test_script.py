"""Splitting and parsing of scripts; no Spark."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.plans.hints import duration, parse_hints
from tidemark.plans.statements import AddColumn, CreateTable, Definition, Distinct, Export, Import, Insert, NextBatch, parse_script, spark_type
from tidemark.plans.tokens import ScriptError, lex, significant, sql


@given(st.text(alphabet="ab '\"`-/*+();:=.,\n1", max_size=40))
def test_lexing_keeps_every_character(text):
    try:
        tokens = lex(text)
    except ScriptError:
        return
    assert "".join(t.text for t in tokens) == text


def test_all_statement_kinds():
    text = """
    IMPORT a.b-c.*;
    IMPORT a.T AS x;
    -- a comment; not a statement
    /** Docs
     *  of T */
    /*+ no_query, index(HASH, id), query_by_any(id, name) */
    T := SELECT ';' AS x FROM s;
    T.c := x || '1';
    D := DISTINCT s ON a, b ORDER BY t DESC NULLS LAST;
    F(a INT NOT NULL, b STRING) := SELECT * FROM s WHERE a = :a AND b = :b;
    T.rel(n BIGINT) := SELECT * FROM s WHERE s.id = this.id LIMIT 3;
    P RETURNS (k BIGINT NOT NULL) := SELECT 1;
    S := SUBSCRIBE SELECT * FROM s;
    CREATE VIEW V AS SELECT * FROM s;
    INSERT INTO T (a, b) SELECT a, b FROM s;
    EXPORT T TO print.me;
    NEXT_BATCH;
    """
    s = parse_script(text)
    kinds = [Import, Import, Definition, AddColumn, Distinct, Definition, Definition, Definition, Definition, Definition, Insert, Export, NextBatch]
    assert [type(x) for x in s] == kinds
    assert s[0].path == ("a", "b-c", "*") and s[1].alias == "x"
    assert s[2].doc == "Docs\nof T" and s[2].hints.args("index") == ["HASH", "id"] and "no_query" in s[2].hints
    assert s[4].keys == ["a", "b"] and s[4].order == [("t", True, True)]
    assert [(a.name, a.type, a.nullable) for a in s[5].arguments] == [("a", "INT", False), ("b", "STRING", True)]
    assert s[6].name == ("T", "rel") and s[7].returns[0].name == "k" and s[8].subscribe
    assert s[10].columns == ["a", "b"] and s[11].target == ("print", "me")


def test_create_table():
    (t,) = parse_script(
        """CREATE TABLE Orders (id BIGINT NOT NULL, `time` TIMESTAMP_LTZ(3), total DECIMAL(10, 2), items ARRAY<ROW<pid BIGINT, q INT>>, m MAP<STRING, DOUBLE>, twice AS total * 2, ts TIMESTAMP(3) METADATA FROM 'timestamp',
        PRIMARY KEY (id, `time`) NOT ENFORCED, WATERMARK FOR `time` AS `time` - INTERVAL '0.001' SECOND) PARTITIONED BY (id) WITH ('connector' = 'filesystem', 'path' = '/x;y', 'format' = 'flexible-json')"""
    )
    assert isinstance(t, CreateTable) and t.primary_key == ["id", "time"] and t.partitioned_by == ["id"]
    assert t.options == {"connector": "filesystem", "path": "/x;y", "format": "flexible-json"}
    assert [(c.name, c.type) for c in t.columns[:5]] == [("id", "BIGINT"), ("time", "TIMESTAMP"), ("total", "DECIMAL(10,2)"), ("items", "ARRAY<STRUCT<`pid`: BIGINT, `q`: INT>>"), ("m", "MAP<STRING, DOUBLE>")]
    assert t.columns[5].computed == "total * 2" and t.columns[6].metadata == "timestamp" and t.columns[6].type == "TIMESTAMP_NTZ"
    assert t.watermark[0] == "time" and not t.columns[0].nullable


@pytest.mark.parametrize(("declared", "spark"), [("VARCHAR(20)", "STRING"), ("TIMESTAMP(3) WITH LOCAL TIME ZONE", "TIMESTAMP"), ("BYTES", "BINARY"), ("INTEGER", "INT"), ("ROW(a INT, b STRING) ARRAY", "ARRAY<STRUCT<`a`: INT, `b`: STRING>>"), ("NUMERIC", "DECIMAL(10,0)"), ("MULTISET<INT>", "ARRAY<INT>")])
def test_types(declared, spark):
    assert spark_type(lex(declared)) == spark


@pytest.mark.parametrize("text", ["T := ;", "T = SELECT 1;", "EXPORT T;", "a.b.c := SELECT 1;", "T := DISTINCT s ON a;", "T := DISTINCT s ORDER BY a;", "ALTER TABLE t ADD x;", "T := 'unfinished;", "T := foo(1);", "T.r := SUBSCRIBE SELECT 1;", "CREATE CATALOG c;", "INSERT t SELECT 1;", "IMPORT ;"])
def test_mistakes(text):
    with pytest.raises(ScriptError):
        parse_script(text)


def test_mistakes_have_their_line():
    with pytest.raises(ScriptError) as e:
        parse_script("T := SELECT 1;\n\nnonsense here;")
    assert e.value.line == 3


def test_hints():
    h = parse_hints("/*+ ttl(5 minutes), row_count(id, 1000), insert(BATCH), other */")
    assert h.seconds("ttl") == 300 and h.row_count == 1000 and h.unknown == ["other"] and h.columns == ["id"]
    for bad in ("row_count(a)", "index(FOO, a)", "vector_dim(v, 0)", "insert(X)", "primary_key", "ttl(5 parsecs)", "engine(a, b)"):
        with pytest.raises(ScriptError):
            parse_hints(f"/*+ {bad} */")
    assert duration("2 weeks") == 1209600


def test_text_for_spark():
    assert sql(lex("""SELECT "a", 'it''s', 'a\\d' FROM `b` -- end""")) == "SELECT `a`, 'it\\'s', r'a\\d' FROM `b`"
    assert [t.text for t in significant(lex("a /* x */ b"))] == ["a", "b"]
