"""More registered queries: functions that the first catalogue leaves out, and statements that change, import, export or describe tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import StateTable, expired
from ..sources.scratch import scratch
from .catalog import ORACLE_SQL, QUERIES, engine, frame, plain, read, script
from .engine import Engine

__all__ = ["ORACLE_SQL", "QUERIES"]

# ---- functions

plain(
    "fn_trigonometry",
    "SELECT DISTINCT p_size, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 6) AS t, round(asin(p_size / 100.0), 9) AS asn, round(acos(p_size / 100.0), 9) AS acs, round(atan(p_size), 9) AS atn, round(atan2(p_size, 3), 9) AS at2, round(sinh(p_size / 10.0), 6) AS sh, round(cosh(p_size / 10.0), 6) AS ch, round(tanh(p_size / 10.0), 9) AS th, round(cot(p_size), 6) AS ct, round(degrees(p_size), 6) AS dg, round(radians(p_size), 9) AS rd, round(pi(), 9) AS pie, round(exp(p_size / 10.0), 6) AS ex, round(log10(p_size), 9) AS lg, round(sqrt(p_size), 9) AS sq, least(p_size, 7) AS le FROM part",
)
script("fn_log_base", "Result := SELECT DISTINCT p_size, round(LOG(3, p_size), 6) AS l3, SIGN(p_size - 25) AS sg, FLOOR(p_size / 3.0D) AS fl, TRUNCATE(p_size / 7.0D, 2) AS t2, ROUND(p_size / 7.0D, 3) AS r3 FROM part;", "SELECT DISTINCT p_size, round(ln(p_size) / ln(3), 6) AS l3, sign(p_size - 25)::DOUBLE AS sg, floor(p_size / 3.0)::BIGINT AS fl, trunc(p_size / 7.0 * 100) / 100 AS t2, round(p_size / 7.0, 3) AS r3 FROM part")
script(
    "fn_random",
    "Result := SELECT n_nationkey, RAND() >= 0 AND RAND() < 1 AS unit, RAND_INTEGER(7) BETWEEN 0 AND 6 AS whole, RAND(5) = RAND(5) AS seeded, REGEXP(UUID(), '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') AS form, UUID() = UUID() AS same FROM nation;",
    "SELECT n_nationkey, true AS unit, true AS whole, true AS seeded, true AS form, false AS same FROM nation",
)
script(
    "fn_random_spread",
    "Result := SELECT count(*) AS n, count(DISTINCT u) AS ids, min(i) AS low, max(i) AS high, count(DISTINCT i) AS kinds, abs(avg(r) - 0.5) < 0.05 AS even FROM (SELECT UUID() AS u, RAND_INTEGER(5) AS i, RAND() AS r FROM lineitem);",
    "SELECT count(*) AS n, count(*) AS ids, 0 AS low, 4 AS high, 5::BIGINT AS kinds, true AS even FROM lineitem",
)
script(
    "fn_encoding",
    "Result := SELECT n_nationkey, UNHEX(HEX(n_name)) AS back, HEX(n_name) AS hx, DECODE(ENCODE(n_name, 'UTF-8'), 'UTF-8') AS dec, DECODE(ENCODE(n_name, 'UTF-16BE'), 'UTF-16BE') AS dec16, length(ENCODE(n_name, 'UTF-16BE')) AS len16, PRINTF('%05d|%s', n_nationkey, n_name) AS pf, FORMAT('%s-%d', n_name, n_regionkey) AS fm, CHR(65 + n_regionkey) AS ch, ASCII(n_name) AS asc FROM nation;",
    "SELECT n_nationkey, n_name AS back, hex(n_name) AS hx, n_name AS dec, n_name AS dec16, 2 * length(n_name)::INT AS len16, printf('%05d|%s', n_nationkey, n_name) AS pf, n_name || '-' || n_regionkey AS fm, chr(65 + n_regionkey::INT) AS ch, ascii(n_name) AS asc FROM nation",
)
script(
    "fn_string_more",
    "Result := SELECT p_partkey, LOWER(p_type) AS lo, INITCAP(p_name) AS ic, BTRIM(concat('xx', p_name, 'x'), 'x') AS bt, LTRIM(concat('  ', p_name)) AS lt, RTRIM(concat(p_name, '  ')) AS rt, LPAD(p_brand, 12, '*') AS lp, RPAD(p_brand, 12, '*') AS rp, OVERLAY(p_name PLACING 'XY' FROM 2 FOR 3) AS ov, POSITION('e' IN p_name) AS po, LEFT(p_name, 3) AS l3, RIGHT(p_name, 3) AS r3, REPEAT(p_brand, 2) AS re, REVERSE(p_name) AS rv, TRANSLATE(p_type, 'AEI', '431') AS tl, CONCAT_WS('/', p_brand, p_type) AS cw, SPLIT(p_name, ' ')[1] AS sp FROM part;",
    "SELECT p_partkey, lower(p_type) AS lo, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS ic, trim('xx' || p_name || 'x', 'x') AS bt, p_name AS lt, p_name AS rt, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, p_name[1:1] || 'XY' || p_name[5:] AS ov, instr(p_name, 'e')::INT AS po, left(p_name, 3) AS l3, right(p_name, 3) AS r3, p_brand || p_brand AS re, reverse(p_name) AS rv, translate(p_type, 'AEI', '431') AS tl, p_brand || '/' || p_type AS cw, split_part(p_name, ' ', 1) AS sp FROM part",
)
script(
    "fn_regex_more",
    "Result := SELECT p_partkey, REGEXP_INSTR(p_name, '[aeiou]') AS ri, REGEXP_SUBSTR(p_name, '[a-z]+e') AS rs, array_join(REGEXP_EXTRACT_ALL(p_brand, '([0-9])', 1), '+') AS al FROM part;",
    "SELECT p_partkey, coalesce(length(regexp_extract(p_name, '^[^aeiou]*[aeiou]')), 0)::INT AS ri, nullif(regexp_extract(p_name, '[a-z]+e'), '') AS rs, array_to_string(regexp_extract_all(p_brand, '([0-9])', 1), '+') AS al FROM part",
)
script(
    "fn_now",
    "Result := SELECT r_regionkey, CAST(NOW() AS DATE) = CURRENT_DATE AS today, abs(UNIX_TIMESTAMP() - CAST(NOW() AS BIGINT)) <= 60 AS unix, CAST(CURRENT_TIMESTAMP AS DATE) = CURRENT_DATE AS stamp, CAST(LOCALTIMESTAMP AS DATE) = CURRENT_DATE AS here, CAST(CURRENT_ROW_TIMESTAMP() AS DATE) = CURRENT_DATE AS row_now, CAST(CURRENT_DATE AS STRING) AS day, CAST(LOCALTIME AS STRING) <= CAST(CURRENT_TIME AS STRING) AS clock FROM region;",
    "SELECT r_regionkey, true AS today, true AS unix, true AS stamp, true AS here, true AS row_now, strftime(now() AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, true AS clock FROM region",
)
script(
    "fn_literals_of_time",
    "Result := SELECT o_orderkey, o_orderdate > TIMESTAMP '1998-01-01 00:00:00' AS later, CAST(o_orderdate AS DATE) = DATE '1998-01-01' AS day, EXTRACT(DAY FROM o_orderdate) AS ex, TIMESTAMPADD(MONTH, 1, o_orderdate) AS plus_month, TIMESTAMPADD(HOUR, -5, o_orderdate) AS back, TIMESTAMPDIFF(HOUR, TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS hours, TIMESTAMPDIFF(MONTH, TIMESTAMP '1995-01-15 00:00:00', o_orderdate) AS months, o_orderdate + INTERVAL '2' DAY AS i2, CAST(TO_TIMESTAMP_LTZ(1700000000, 0) AS BIGINT) AS ltz FROM orders;",
    "SELECT o_orderkey, o_orderdate > TIMESTAMP '1998-01-01 00:00:00' AS later, o_orderdate::DATE = DATE '1998-01-01' AS day, day(o_orderdate)::INT AS ex, o_orderdate + INTERVAL 1 MONTH AS plus_month, o_orderdate - INTERVAL 5 HOUR AS back, date_sub('hour', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS hours, date_sub('month', TIMESTAMP '1995-01-15 00:00:00', o_orderdate) AS months, o_orderdate + INTERVAL 2 DAY AS i2, 1700000000::BIGINT AS ltz FROM orders",
)
script(
    "fn_date_units",
    "Result := SELECT event_id, FLOOR(ts TO HOUR) AS h, FLOOR(ts TO DAY) AS d, FLOOR(ts TO YEAR) AS y, CEIL(ts TO HOUR) AS ch, CEIL(ts TO DAY) AS cd, TEMPORALOVERLAPS(ts, ts + INTERVAL '1' HOUR, TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-10 02:00:00') AS ov FROM events;",
    "SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS h, date_trunc('day', ts)::TIMESTAMP AS d, date_trunc('year', ts)::TIMESTAMP AS y, CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS ch, CASE WHEN date_trunc('day', ts) = ts THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END::TIMESTAMP AS cd, ts < TIMESTAMP '2024-01-10 02:00:00' AND TIMESTAMP '2024-01-10 00:00:00' < ts + INTERVAL 1 HOUR AS ov FROM events",
)
script(
    "fn_array_more",
    "_A := SELECT n_nationkey AS k, ARRAY[n_nationkey, n_regionkey] AS a FROM nation; Result := SELECT k, ELEMENT(ARRAY[k]) AS el, array_join(ARRAY_SORT(ARRAY_UNION(a, ARRAY[3, 9])), ',') AS un, array_join(ARRAY_SORT(ARRAY_INTERSECT(a, ARRAY[1, 2, 3])), ',') AS it, ARRAY_JOIN(a, '|') AS aj, array_join(ARRAY_APPEND(a, 8), ',') AS ap, array_join(ARRAY_SLICE(a, -1), ',') AS tail FROM _A;",
    "WITH a AS (SELECT n_nationkey AS k, [n_nationkey, n_regionkey] AS a FROM nation) SELECT k, k AS el, array_to_string(list_sort(list_distinct(a || [3, 9])), ',') AS un, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x IN (1, 2, 3)))), ',') AS it, a[1] || '|' || a[2] AS aj, a[1] || ',' || a[2] || ',8' AS ap, a[2]::VARCHAR AS tail FROM a",
)
script(
    "fn_map_more",
    "_M := SELECT n_nationkey AS k, MAP_FROM_ARRAYS(ARRAY['name', 'key'], ARRAY[n_name, CAST(n_nationkey AS STRING)]) AS m FROM nation; Result := SELECT k, m['name'] AS name, CARDINALITY(MAP_ENTRIES(m)) AS n, MAP_ENTRIES(m)[1].value AS first FROM _M;",
    "SELECT n_nationkey AS k, n_name AS name, 2 AS n, n_name AS first FROM nation",
)

#: Digests that DuckDB lacks are taken of fixed words, by another library.
_WORDS = ("abc", "tide mark", "", "Grüße 字")
script(
    "fn_sha",
    f"Result := SELECT w, SHA224(w) AS s224, SHA256(w) AS s256, SHA384(w) AS s384, SHA512(w) AS s512, SHA2(w, 512) AS s2, SHA1(w) AS s1, MD5(w) AS m FROM (VALUES {', '.join(f"('{w}')" for w in _WORDS)}) AS t(w);",
    "SELECT * FROM (VALUES " + ", ".join("('" + w + "', " + ", ".join(f"'{hashlib.new(h, w.encode()).hexdigest()}'" for h in ("sha224", "sha256", "sha384", "sha512", "sha512", "sha1", "md5")) + ")" for w in _WORDS) + ") AS t(w, s224, s256, s384, s512, s2, s1, m)",
)
script(
    "fn_hash_columns",
    "Result := SELECT n_regionkey, count(*) AS n, count(DISTINCT HASH_COLUMNS(n_nationkey, n_name)) AS keys, min(HASH_COLUMNS(n_regionkey)) AS h FROM nation GROUP BY n_regionkey;",
    """SELECT n_regionkey, count(*) AS n, count(DISTINCT (n_nationkey, n_name)) AS keys, sha256('{"c0":' || n_regionkey || '}') AS h FROM nation GROUP BY n_regionkey""",
)
script(
    "fn_json_more",
    """Result := SELECT event_id, JSON_STRING(event_type) AS quoted, JSON_STRING(event_id) AS number, JSON_UNQUOTE(JSON_QUOTE(event_type)) AS back, JSON_ARRAY(event_id, event_type) AS arr, JSON_VALUE(props, '$.none') AS missing, IS_JSON('{bad') AS bad, JSON_VALUE(to_json(PARSE_JSON(props)), '$.k') AS parsed, TRY_PARSE_JSON('{bad') IS NULL AS tried, to_json(OBJECT_OF('id', event_id)) AS obj FROM events;""",
    """SELECT event_id, '"' || event_type || '"' AS quoted, event_id::VARCHAR AS number, event_type AS back, '[' || event_id || ',"' || event_type || '"]' AS arr, NULL::VARCHAR AS missing, false AS bad, props->>'$.k' AS parsed, true AS tried, '{"id":' || event_id || '}' AS obj FROM events""",
)
script(
    "fn_sum0",
    "Result := SELECT c_mktsegment, SUM0(CASE WHEN c_acctbal < -900 THEN c_custkey END) AS some, SUM0(CASE WHEN c_acctbal > 1e12 THEN c_custkey END) AS none FROM customer GROUP BY c_mktsegment;",
    "SELECT c_mktsegment, coalesce(sum(c_custkey) FILTER (WHERE c_acctbal < -900), 0)::BIGINT AS some, 0::BIGINT AS none FROM customer GROUP BY c_mktsegment",
)
script(
    "fn_cast_more",
    "Result := SELECT o_orderkey, CAST(o_orderkey % 2 AS BOOLEAN) AS b, TRY_CAST(o_orderpriority AS BOOLEAN) AS nb, TRY_CAST('1.50' AS DECIMAL(5, 2)) AS d, TRY_CAST(CAST(o_orderdate AS STRING) AS TIMESTAMP(3)) AS ts, CAST(o_totalprice AS BIGINT) AS whole, CURRENT_DATABASE() AS db FROM orders;",
    "SELECT o_orderkey, (o_orderkey % 2)::BOOLEAN AS b, NULL::BOOLEAN AS nb, 1.50::DECIMAL(5, 2) AS d, o_orderdate AS ts, trunc(o_totalprice)::BIGINT AS whole, 'default' AS db FROM orders",
)
script(
    "fn_vector_more",
    "_V := SELECT vec_id, label, DOUBLE_TO_VECTOR(embedding) AS v FROM embeddings; Result := SELECT vec_id, CARDINALITY(VECTOR_TO_DOUBLE(v)) AS dim, round(VECTOR_TO_DOUBLE(v)[1], 6) AS first, round(COSINE_SIMILARITY(v, v), 6) AS one FROM _V;",
    "SELECT vec_id, len(embedding)::INT AS dim, round(embedding[1]::DOUBLE, 6) AS first, 1.0::DOUBLE AS one FROM embeddings",
)
script(
    "text_search_rank",
    "Result := SELECT p_partkey, round(text_search('widgets', p_name, p_type), 9) AS rank FROM part WHERE text_search('widgets', p_name, p_type) > 0;",
    "SELECT p_partkey, round(len(list_filter(w, lambda x: x IN ('widget', 'widgets'))) / (1.0 + ln(1 + len(w))), 9) AS rank FROM (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM part) WHERE list_has_any(w, ['widget', 'widgets'])",
)

# ---- statements


def _files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with some of the tables in the text formats that scripts read, and their definitions."""
    folder = scratch(spark, "catalog")
    read(spark, sf_dir, "nation").coalesce(1).write.json(f"{folder}/nation.jsonl")
    read(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_name", "s_nationkey", "s_acctbal").coalesce(1).write.option("header", True).csv(f"{folder}/supplier.csv")
    read(spark, sf_dir, "region").coalesce(1).write.option("compression", "gzip").json(f"{folder}/region.json.gz")
    return folder


def _with_files(spark: SparkSession, sf_dir: str, text: str) -> tuple[Engine, str]:
    folder = _files(spark, sf_dir)
    ddl = "".join(
        f"CREATE TABLE {name} ({columns}) WITH ('connector' = 'filesystem', 'format' = '{kind}', 'path' = '{folder}/{path}');\n"
        for name, columns, kind, path in (("Nations", "n_nationkey BIGINT, n_name STRING, n_regionkey BIGINT", "json", "nation.jsonl"), ("Suppliers", "s_suppkey BIGINT, s_name STRING, s_nationkey BIGINT, s_acctbal DOUBLE", "csv", "supplier.csv"), ("Regions", "r_regionkey BIGINT, r_name STRING", "json", "region.json.gz"))
    )
    return Engine(spark).run(ddl + text.replace("{folder}", folder)), folder


@frame("create_table_files", "SELECT s_suppkey, s_name, n_name, r_name, round(s_acctbal, 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def create_table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, CSV and gzipped JSON read through CREATE TABLE."""
    text = "Result := SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name, round(s.s_acctbal, 2) AS balance FROM Suppliers s JOIN Nations n ON s.s_nationkey = n.n_nationkey JOIN Regions r ON n.n_regionkey = r.r_regionkey;"
    return _with_files(spark, sf_dir, text)[0].query("Result")


@frame("export_then_read", "SELECT n_nationkey AS id, upper(n_name) AS name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2")
def export_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of one script, written to a file sink in turn and read back."""
    text = """CREATE TABLE Sink (id BIGINT, name STRING) WITH ('connector' = 'filesystem', 'format' = 'json', 'path' = '{folder}/sink');
    First := SELECT n_nationkey AS id, upper(n_name) AS name FROM Nations; EXPORT First TO Sink; NEXT_BATCH; INSERT INTO Sink SELECT n_nationkey + 100, n_name FROM Nations WHERE n_regionkey = 2;"""
    e, folder = _with_files(spark, sf_dir, text)
    e.execute(f"{folder}/out")
    return spark.read.schema("id long, name string").json(f"{folder}/sink")


@frame("next_batch_order", "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey")
def next_batch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second batch reads what the first has written."""
    text = """CREATE TABLE Sink (k BIGINT) WITH ('connector' = 'filesystem', 'format' = 'parquet', 'path' = '{folder}/keys');
    CREATE TABLE Counts (k BIGINT, n BIGINT) WITH ('connector' = 'filesystem', 'format' = 'parquet', 'path' = '{folder}/counts');
    Keys := SELECT n_regionkey AS k FROM Nations; EXPORT Keys TO Sink; NEXT_BATCH;
    Counted := SELECT k, count(*) AS n FROM Sink GROUP BY k; EXPORT Counted TO Counts;"""
    e, folder = _with_files(spark, sf_dir, text)
    e.execute(f"{folder}/out")
    return spark.read.parquet(f"{folder}/counts")


@frame("create_view_and_use", "SELECT n_name FROM nation WHERE n_regionkey = 1")
def create_view_and_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "CREATE VIEW Some AS SELECT n_name, n_regionkey FROM nation; Result := SELECT n_name FROM Some WHERE n_regionkey = 1;").query("Result")


@frame("comments_and_docs", "SELECT r_regionkey, r_name, 'Regions of the world.' AS doc FROM region")
def comments_and_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "-- a remark; with a semicolon\n/* another */\n/** Regions of the world. */\nResult := SELECT r_regionkey, r_name /* inside */ FROM region; -- the end"
    e = engine(spark, sf_dir, text)
    return e.query("Result").withColumn("doc", F.lit(e.table("Result").doc.strip()))


@frame("catalog_of_tables", "SELECT * FROM (VALUES ('Shown', 'r_name'), ('Shown', 'r_regionkey')) AS t(name, col)")
def catalog_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that requests can see: hidden, unlisted and test tables aren't among them."""
    e = engine(spark, sf_dir, "_Hidden := SELECT r_name FROM region; /*+ no_query */ Quiet := SELECT r_name FROM region; /*+ test */ Tested := SELECT r_name FROM region; /*+ workload */ Load := SELECT r_name FROM region; Shown := SELECT r_regionkey, r_name FROM region;")
    known = e.catalog()
    return spark.createDataFrame([(n, c) for n in ("_Hidden", "Quiet", "Tested", "Load", "Shown") if n in known for c in e.table(n).df.columns], "name string, col string")


def _typed(e: Engine, *names: str) -> list[tuple[str, str, str]]:
    return [(n, e.table(n).type.name, json.dumps(e.table(n).primary_key)) for n in names]


@frame(
    "types_and_keys",
    """SELECT * FROM (VALUES ('Kept', 'STREAM', '["event_id"]'), ('Agg', 'STATE', '["user_id"]'), ('Latest', 'VERSIONED_STATE', '["user_id"]'), ('Win', 'STREAM', '["window_start", "window_end"]'), ('Named', 'STREAM', '["ts"]')) AS t(name, kind, key)""",
)
def types_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine says of tables, the hinted key among it."""
    text = """Kept := SELECT * FROM events WHERE value > 1; Agg := SELECT user_id, count(*) AS n FROM events GROUP BY user_id; Latest := DISTINCT events ON user_id ORDER BY ts DESC;
    Win := SELECT window_start, window_end, count(*) AS n FROM TABLE(TUMBLE(TABLE events, DESCRIPTOR(ts), INTERVAL '1' HOUR)) GROUP BY window_start, window_end; /*+ primary_key(ts) */ Named := SELECT ts, value FROM events;"""
    return spark.createDataFrame(_typed(engine(spark, sf_dir, text), "Kept", "Agg", "Latest", "Win", "Named"), "name string, kind string, key string")


@frame("partition_key_files", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def partition_key_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table lies in a folder for each value of its partition key; the counts are of one folder each."""
    folder = scratch(spark, "catalog")
    e = engine(spark, sf_dir, "/*+ partition_key(o_orderstatus) */ Parted := SELECT o_orderkey, o_orderstatus FROM orders;")
    e.materialize(folder, ["Parted"])
    files = spark.read.format("parquet").option("basePath", f"{folder}/Parted").load(f"{folder}/Parted/o_orderstatus=*").select(F.regexp_extract("_metadata.file_path", "o_orderstatus=([^/]+)", 1).alias("status"))
    return files.groupBy("status").agg(F.count("*").alias("n"))


@frame("index_compaction", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 50")
def index_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "catalog")
    e = engine(spark, sf_dir, "/*+ index(BTREE, o_orderkey) */ Indexed := SELECT o_orderkey, o_totalprice FROM orders;")
    e.materialize(folder, ["Indexed"])
    e.compact(folder, "Indexed")
    return e.query("Indexed").filter("o_orderkey < 50")


@frame("ttl_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 5 DAY")
def ttl_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within the retention of a fixed now."""
    return expired(read(spark, sf_dir, "events"), "ts", 5 * 86400, F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")).select("event_id")


@frame("appended_rows", "SELECT r_regionkey AS id, r_name AS name FROM region WHERE r_name IS NOT NULL")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows given to a table of the log, whole batches and single ones; those without a needed value are left out."""
    e = Engine(spark, log_folder=scratch(spark, "catalog")).run("/*+ engine(kafka) */ CREATE TABLE Places (id BIGINT NOT NULL, name STRING);")
    e.append("Places", read(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS id", "r_name AS name").filter("id > 1"))
    for r in ({"id": 0, "name": None}, {"id": 1, "name": None}, {"name": "no id"}):
        names = {0: "AFRICA", 1: "AMERICA"}
        e.append("Places", [r if "id" not in r else r | {"name": names[r["id"]]}])
    return e.query("Places").select("id", "name")


@frame("user_function", "SELECT n_nationkey, length(n_name) * 2 AS twice FROM nation")
def user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function known to scripts by name."""
    e = Engine(spark, tables={"nation": read(spark, sf_dir, "nation")})
    e.register_function("twice_length", lambda s: None if s is None else 2 * len(s), "bigint")
    return e.run("Result := SELECT n_nationkey, twice_length(n_name) AS twice FROM nation;").query("Result")


@frame("import_with_alias", "SELECT n_name AS name FROM nation WHERE n_regionkey = 3")
def import_with_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script imported from a folder, its tables under another name."""
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # scripts are read by the driver alone
        with open(os.path.join(folder, "lib.script"), "w") as f:
            f.write("Some := SELECT n_name AS name, n_regionkey FROM nation;")
        e = Engine(spark, [folder], {"nation": read(spark, sf_dir, "nation")})
        e.run("IMPORT lib.Some AS Other; Result := SELECT name FROM Other WHERE n_regionkey = 3;")
        return e.query("Result")


@frame("state_table_writes", "SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id")
def state_table_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of state after three writes, one of them repeated."""
    e = read(spark, sf_dir, "events").select("user_id", "ts")
    state = StateTable(spark, scratch(spark, "catalog"), e.schema, ["user_id"], "newer", "ts")
    for part in (0, 1, 0, 2):
        state.write(e.filter(F.col("ts").isNotNull() & (F.dayofmonth("ts") % 3 == part)))
    return state.read()


@frame("notices", "SELECT * FROM (VALUES ('temporal join'), ('HOP')) AS t(word)")
def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine advises: a missed temporal join, a sliding recency filter."""
    text = """Latest := DISTINCT events ON user_id ORDER BY ts DESC; Missed := SELECT e.event_id, l.value FROM events e JOIN Latest l ON e.user_id = l.user_id;
    Recent := SELECT user_id, count(*) AS n FROM events WHERE ts > NOW() - INTERVAL '1' HOUR GROUP BY user_id;"""
    e = engine(spark, sf_dir, text)
    return spark.createDataFrame([(w,) for w in ("temporal join", "HOP", "no such advice") if any(w in n for n in e.notices)], "word string")


@frame("stages_by_cost", "SELECT * FROM (VALUES ('Once', 'view'), ('Shared', 'table')) AS t(name, stage)")
def stages_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join that two tables read is stored; a projection that one reads is a view."""
    text = "Shared := SELECT a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id; Once := SELECT event_id FROM Shared; Twice := SELECT other FROM Shared;"
    stages = engine(spark, sf_dir, text).stages()
    return spark.createDataFrame([(n, stages[n]) for n in ("Once", "Shared")], "name string, stage string")


@frame("ordered_pages", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place BETWEEN 11 AND 30")
def ordered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a definition is applied on reading; rows are numbered as they come, two pages after one another."""
    e = engine(spark, sf_dir, "Dear := SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey;")
    found = [r["o_orderkey"] for at in (10, 20) for r in e.query("Dear", limit=10, offset=at).collect()]
    return spark.createDataFrame([(k, i + 11) for i, k in enumerate(found)], "o_orderkey long, place long")
