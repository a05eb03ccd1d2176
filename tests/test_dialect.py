"""Expressions of the dialect through the whole engine: what each gives."""

import datetime as dt
import decimal

import pytest

from tidemark.plans.engine import Engine

NULL = None
CASES = [
    # numbers
    ("LOG2(32)", 5.0), ("LOG(1)", 0.0), ("LOG(3, 81)", 4.0), ("ROUND(E(), 4)", 2.7183), ("RAND() >= 0", True), ("RAND(7) < 1", True), ("RAND_INTEGER(5) BETWEEN 0 AND 4", True), ("RAND_INTEGER(1, 5) < 5", True), ("BIN(6)", "110"), ("HEX(31)", "1F"),
    ("HEX('Az')", "417A"), ("UNHEX('417A')", "Az"), ("TRUNCATE(9.876, 1)", 9.8), ("TRUNCATE(-9.876)", -9.0), ("MOD(7, 4)", 3), ("SUM0(CAST(NULL AS INT))", 0), ("POWER(2, 5)", 32.0),
    # strings
    ("PRINTF('%s=%d', 'n', 4)", "n=4"), ("FORMAT('%s!', 'hey')", "hey!"), ("STARTSWITH('tide', 'ti')", True), ("ENDSWITH('tide', 'ti')", False), ("REGEXP_EXTRACT('ab12', '[0-9]+')", "12"), (r"REGEXP_EXTRACT('x7y8', '(\d)y(\d)', 2)", "8"),
    (r"REGEXP_EXTRACT_ALL('p1q2', '(\d)', 1)", ["1", "2"]), (r"REGEXP('a1', '\d')", True), (r"REGEXP('a1', '\\d')", False), ("DECODE(ENCODE('ok', 'UTF-8'), 'UTF-8')", "ok"), ("FROM_BASE64('b2s=')", "ok"), ("TO_BASE64('ok')", "b2s="),
    ("INSTR('abcabc', 'c')", 3), ("LOCATE('c', 'abcabc', 4)", 6), ("SPLIT_INDEX('x;y;z', ';', 2)", "z"), ("SPLIT_INDEX('x;y;z', ';', 3)", NULL), ("SPLIT_INDEX('x;y;z', ';', -1)", NULL), ("SPLIT('p|q', '|')", ["p", "|", "q", ""]), ("ELT(3, 'a', 'b', 'c')", "c"),
    ("JSON_QUOTE('say \"hi\"')", '"say \\"hi\\""'), ("JSON_UNQUOTE('\"hi\"')", "hi"), ("SUBSTRING('abcdef', 0, 2)", "ab"), ("OVERLAY('abcd' PLACING 'XY' FROM 2 FOR 2)", "aXYd"), ("BTRIM('  a ')", "a"), ("LOWERCASE('AB') || UPPERCASE('cd')", "abCD"),
    ("REGEXP_REPLACE('a-b-c', '-', '')", "abc"), ("REGEXP_COUNT('banana', 'an')", 2), ("REGEXP_INSTR('banana', 'n')", 3), ("REGEXP_SUBSTR('banana', 'n.')", "na"), ("'it''s'", "it's"), ("URL_ENCODE('a b')", "a+b"), ("PARSE_URL('http://h.x/p?q=1', 'QUERY', 'q')", "1"),
    ("IS_ALPHA('abC')", True), ("IS_DIGIT('12a')", False), ("IS_DECIMAL('+1.50')", True), ("INITCAP('ab cd')", "Ab Cd"),
    # casts and conditions
    ("TRY_CAST('12' AS INT)", 12), ("TRY_CAST('x' AS BIGINT)", NULL), ("TRY_CAST('1.25' AS DECIMAL(5, 2))", decimal.Decimal("1.25")), ("CAST(5 AS VARCHAR(10))", "5"), ("TRY_CAST('2024-05-06 07:08:09' AS TIMESTAMP(3))", dt.datetime(2024, 5, 6, 7, 8, 9)),
    ("TYPEOF(CAST('2024-05-06 07:08:09' AS TIMESTAMP_LTZ(3)))", "timestamp"), ("IF(2 > 1, 'a', 'b')", "a"), ("IFNULL(CAST(NULL AS STRING), 'd')", "d"), ("COALESCE(NULL, 3)", 3), ("IFTHENELSE(false, 1, 2)", 2),
    # time
    ("NOW() IS NOT NULL", True), ("LOCALTIME IS NOT NULL", True), ("LOCALTIMESTAMP IS NOT NULL", True), ("CURRENT_TIME IS NOT NULL", True), ("CURRENT_DATE IS NOT NULL", True), ("CURRENT_TIMESTAMP IS NOT NULL", True), ("PROCTIME() IS NOT NULL", True), ("CURRENT_ROW_TIMESTAMP() IS NOT NULL", True),
    ("QUARTER(DATE '2023-11-30')", 4), ("WEEK(DATE '2023-11-30')", 48), ("DAYOFWEEK(DATE '2023-11-30')", 5), ("DAYOFYEAR(DATE '2023-02-01')", 32), ("FLOOR(TIMESTAMP '2023-11-30 10:20:30' TO HOUR)", dt.datetime(2023, 11, 30, 10)),
    ("CEIL(TIMESTAMP '2023-11-30 10:20:30' TO HOUR)", dt.datetime(2023, 11, 30, 11)), ("CEIL(TIMESTAMP '2023-11-30 10:00:00' TO HOUR)", dt.datetime(2023, 11, 30, 10)), ("CEIL(2.1)", 3), ("FLOOR(2.9)", 2), ("DATE_FORMAT(TIMESTAMP '2023-11-30 10:20:30', 'HH:mm')", "10:20"),
    ("DATE_FORMAT('nonsense', 'HH')", NULL), ("TIMESTAMPADD(MONTH, 2, TIMESTAMP '2023-12-31 00:00:00')", dt.datetime(2024, 2, 29)), ("TIMESTAMPDIFF(HOUR, TIMESTAMP '2024-01-01 00:59:00', TIMESTAMP '2024-01-01 02:00:00')", 1),
    ("CONVERT_TZ('2024-07-01 12:00:00', 'UTC', 'Europe/Berlin')", "2024-07-01 14:00:00"), ("FROM_UNIXTIME(86400, 'yyyy-MM-dd')", "1970-01-02"), ("UNIX_TIMESTAMP('1970-01-02 00:00:00')", 86400), ("TO_DATE('03/04/2024', 'dd/MM/yyyy')", dt.date(2024, 4, 3)),
    ("TO_TIMESTAMP('2024-01-02 03:04:05')", dt.datetime(2024, 1, 2, 3, 4, 5)), ("TO_TIMESTAMP('x')", NULL), ("CAST(TO_TIMESTAMP_LTZ(5, 0) AS BIGINT)", 5), ("CAST(TO_TIMESTAMP_LTZ(5000, 3) AS BIGINT)", 5), ("CAST(TO_TIMESTAMP_LTZ('1970-01-01 00:00:09', 'yyyy-MM-dd HH:mm:ss') AS BIGINT)", 9),
    ("TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '90' MINUTE", dt.datetime(2024, 1, 1, 1, 30)), ("TEMPORALOVERLAPS(1, 3, 2, 5)", True),
    # arrays and maps
    ("ELEMENT(ARRAY['z'])", "z"), ("ARRAY[4, 5, 6][1]", 4), ("ARRAY[4, 5, 6][7]", NULL), ("MAP['a', 1, 'b', 2]['b']", 2), ("MAP['a', ARRAY[7, 8]]['a'][2]", 8), ("CARDINALITY(MAP['a', 1])", 1), ("ARRAY_CONTAINS(ARRAY[1, 2], 3)", False),
    ("ARRAY_DISTINCT(ARRAY[1, 1, 2])", [1, 2]), ("ARRAY_PREPEND(ARRAY[2], 1)", [1, 2]), ("ARRAY_SLICE(ARRAY[1, 2, 3, 4], 2, 3)", [2, 3]), ("ARRAY_UNION(ARRAY[1, 2], ARRAY[2, 3])", [1, 2, 3]), ("ARRAY_CONCAT(ARRAY[1], ARRAY[2], ARRAY[2])", [1, 2, 2]), ("ARRAY_EXCEPT(ARRAY[1, 2], ARRAY[1])", [2]),
    ("ARRAY_REVERSE(ARRAY[1, 2])", [2, 1]), ("ARRAY_SORT(ARRAY[2, 1])", [1, 2]), ("ARRAY_INTERSECT(ARRAY[1, 2], ARRAY[2])", [2]), ("ARRAY_MAX(ARRAY[1, 2])", 2), ("ARRAY_JOIN(ARRAY['a', NULL, 'b'], '+', '?')", "a+?+b"), ("ARRAY_POSITION(ARRAY['a', 'b'], 'b')", 2), ("ARRAY_APPEND(ARRAY[1], 2)", [1, 2]),
    ("MAP_KEYS(MAP['a', 1])", ["a"]), ("MAP_UNION(MAP['a', 1], MAP['a', 2])", {"a": 2}), ("MAP_ENTRIES(MAP['a', 1])", [("a", 1)]), ("MAP_FROM_ARRAYS(ARRAY['k'], ARRAY[9])", {"k": 9}), ("STR_TO_MAP('a:1;b:2', ';', ':')", {"a": "1", "b": "2"}),
    # JSON
    ("""JSON_VALUE('{"a": {"b": 3}}', '$.a.b' RETURNING INT)""", 3), ("""JSON_VALUE('{"a": "x"}', '$.a')""", "x"), ("""JSON_VALUE('{"a": 1}', '$.z' NULL ON EMPTY)""", NULL), ("""JSON_QUERY('{"a": [1, 2]}', '$.a')""", "[1,2]"), ("""JSON_EXISTS('{"a": null}', '$.a')""", True),
    ("JSON_OBJECT(KEY 'a' VALUE 1, 'b' VALUE 'x')", '{"a":1,"b":"x"}'), ("JSON_OBJECT('a' VALUE CAST(NULL AS INT) NULL ON NULL)", '{"a":null}'), ("JSON_ARRAY(1, 'x', true)", '[1,"x",true]'), ("JSON_STRING(ARRAY[1, 2])", "[1,2]"), ("IS_JSON('[1')", False),
    ("JSONB_TO_STRING(JSONB_OBJECT('a', ARRAY[1], 'b', CAST(NULL AS INT)))", '{"a":[1],"b":null}'), ("JSONB_QUERY(TO_JSONB('{\"a\": {\"b\": 1}}'), '$.a')", '{"b":1}'), ("JSONB_EXISTS(TO_JSONB('{}'), '$.a')", False), ("JSONB_TO_STRING(TO_JSONB(5))", "5"), ("JSONB_TO_STRING(TO_JSONB(NAMED_STRUCT('a', 1)))", '{"a":1}'),
    # distributions
    ("ROUND(exponential_distribution(2.0, 2.0), 6)", 0.632121), ("normal_distribution(3.0, 3.0, 3.0)", 0.5), ("ROUND(poisson_distribution(2.0, 12), 8)", 0.99999979), ("binomial_distribution(11, 1, 11)", 1.0), ("next_after(1.0, 1.0)", 1.0), ("ulp(1.0) > 0", True), ("scalb(3.0, 2)", 12.0), ("copy_sign(2.0, -1.0)", -2.0),
]


@pytest.fixture(scope="module")
def results(spark):
    e = Engine(spark).run("import stdlib.math.*;")
    cases = CASES
    out = {}
    for i in range(0, len(cases), 40):
        part = cases[i : i + 40]
        plain = [c for c in part if not c[0].startswith("SUM0")]
        text = ", ".join(f"{x} AS c{k}" for k, (x, _) in enumerate(plain))
        e.run(f"T{i} := SELECT {text} FROM (VALUES (1)) AS t(one);")
        row = e.query(f"T{i}").first()
        out |= {x: row[f"c{k}"] for k, (x, _) in enumerate(plain)}
        for x, _ in part:
            if x.startswith("SUM0"):
                out[x] = e.run(f"S{i} := SELECT {x} AS c FROM (VALUES (1)) AS t(one);").query(f"S{i}").first()["c"]
    return out


@pytest.mark.parametrize(("text", "want"), CASES)
def test_expression(results, text, want):
    got = results[text]
    if isinstance(want, float):
        assert float(got) == pytest.approx(want)
    elif isinstance(got, list) and got and not isinstance(got[0], int | str):
        assert [tuple(x) for x in got] == want
    else:
        assert got == want and (want is not NULL or got is None)


def test_vectors_by_hint(spark):
    e = Engine(spark).run(
        """/*+ primary_key(id), vector_dim(v, 2) */ V := SELECT id, k, double_to_vector(v) AS v FROM (VALUES (1, 'a', ARRAY[1.0, 0.0]), (2, 'a', ARRAY[0.0, 1.0]), (3, 'b', ARRAY[1.0, 1.0])) AS t(id, k, v);
        C := SELECT k, vector_to_double(CENTER(v)) AS c FROM V GROUP BY k;
        Like(id INT NOT NULL) := SELECT y.id, ROUND(cosine_similarity(x.v, y.v), 3) AS s FROM V x JOIN V y ON x.id <> y.id WHERE x.id = :id ORDER BY s DESC, y.id ASC;"""
    )
    assert sorted((r["k"], r["c"]) for r in e.query("C").collect()) == [("a", [0.5, 0.5]), ("b", [1.0, 1.0])]
    assert [tuple(r) for r in e.query("Like", id=1).collect()] == [(3, 0.707), (2, 0.0)]


def test_user_functions(spark):
    from pyspark.sql.functions import udtf

    @udtf(returnType="part string")
    class Parts:
        def eval(self, text: str):
            for p in (text or "").split("-"):
                yield (p,)

    e = Engine(spark)
    e.register_function("shout", lambda s: None if s is None else s.upper() + "!", "string")
    e.register_function("parts", Parts)
    e.run("T := SELECT shout(x) AS s, p.part FROM (VALUES ('a-b')) AS t(x), LATERAL TABLE(parts(x)) AS p;")
    assert sorted(tuple(r) for r in e.query("T").collect()) == [("A-B!", "a"), ("A-B!", "b")]
