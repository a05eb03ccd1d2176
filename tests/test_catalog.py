"""Every registered query of the reference's kind gives the rows that its SQL gives in DuckDB."""

import math

import duckdb
import pytest

from tidemark.plans.catalog_more import ORACLE_SQL, QUERIES


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return str(x) if not isinstance(x, int | str | bool | type(None)) else x


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = [tuple(value(r[c]) for c in names) for r in df.collect()]
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    want = [tuple(value(r[i]) for i in at) for r in rel.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["lateral_subquery", "relationship_topk"])
def test_limits_by_key_match_sql_where_keys_repeat(spark, sf, tmp_path, name):
    con = duckdb.connect()
    for t, copies in (("customer", 2), ("orders", 3)):
        con.execute(f"COPY (SELECT x.* FROM '{sf}/{t}.parquet' x, range({copies}) r) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    got = QUERIES[name](spark, str(tmp_path)).select("c_custkey", "o_orderkey").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT c_custkey, o_orderkey FROM ({ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
