"""The dialect's functions in Spark SQL.

A translation takes the SQL texts of the arguments and gives the SQL text of the
call. Functions that Spark has with the same name and meaning aren't listed. All
are built-in expressions; those that need Python are in `functions.python`.
"""

from __future__ import annotations

from collections.abc import Callable

TRANSLATIONS: dict[str, Callable[..., str]] = {}


def translate(*names: str):
    def add(f: Callable[..., str]) -> Callable[..., str]:
        TRANSLATIONS.update({n: f for n in names})
        return f

    return add


def _renamed(names: dict[str, str]) -> None:
    for name, to in names.items():
        TRANSLATIONS[name] = lambda *a, to=to: f"{to}({', '.join(a)})"


_renamed(
    {
        "REGEXP": "regexp_like",
        "TO_BASE64": "base64",
        "ARRAY_CONCAT": "concat",
        "ARRAY_REVERSE": "reverse",
        "MAP_UNION": "map_concat",
        "FORMAT": "format_string",
        "LOWERCASE": "lower",
        "UPPERCASE": "upper",
        "CURRENTDATABASE": "current_database",
        "CURRENT_ROW_TIMESTAMP": "current_timestamp",
        "PROCTIME": "current_timestamp",
        "IFTHENELSE": "if",
        "WEEK": "weekofyear",
        "OBJECT_OF": "named_struct",
        "PARSE_JSON": "parse_json",
        "TRY_PARSE_JSON": "try_parse_json",
    }
)
for _bits in (224, 256, 384, 512):
    TRANSLATIONS[f"SHA{_bits}"] = lambda x, n=_bits: f"sha2({x}, {n})"

# ---- numbers


@translate("RAND_INTEGER")
def _rand_integer(*a: str) -> str:
    return f"CAST(floor(rand({a[0] if len(a) > 1 else ''}) * {a[-1]}) AS INT)"


@translate("TRUNCATE")
def _truncate(x: str, scale: str = "0") -> str:
    return f"(sign({x}) * floor(abs({x}) * pow(10, {scale})) / pow(10, {scale}))"


@translate("COPY_SIGN")
def _copy_sign(x: str, y: str) -> str:
    # a negative zero has its sign in its text only
    return f"IF(startswith(CAST(CAST({y} AS DOUBLE) AS STRING), '-'), -abs(CAST({x} AS DOUBLE)), abs(CAST({x} AS DOUBLE)))"


@translate("SCALB")
def _scalb(x: str, n: str) -> str:
    return f"({x} * pow(2, {n}))"


@translate("EXPONENTIAL_DISTRIBUTION")
def _exponential(mean: str, x: str) -> str:
    return f"IF({x} <= 0, 0D, 1 - exp(-({x}) / CAST({mean} AS DOUBLE)))"


def _on_doubles(name: str) -> None:
    TRANSLATIONS[name.upper()] = lambda *a: f"{name}({', '.join(f'CAST({x} AS DOUBLE)' for x in a)})"


# in functions.python
for _name in ("normal_distribution", "poisson_distribution", "binomial_distribution", "next_after", "ulp"):
    _on_doubles(_name)


@translate("SUM0", "$SUM0")
def _sum0(x: str) -> str:
    return f"coalesce(sum({x}), 0)"


# ---- strings


@translate("UNHEX")
def _unhex(x: str) -> str:
    return f"decode(unhex({x}), 'UTF-8')"


@translate("FROM_BASE64")
def _from_base64(x: str) -> str:
    return f"decode(unbase64({x}), 'UTF-8')"


@translate("REGEXP_EXTRACT")
def _regexp_extract(s: str, p: str, group: str = "0") -> str:
    return f"nullif(regexp_extract({s}, {p}, {group}), '')"


@translate("SPLIT_INDEX")
def _split_index(s: str, d: str, i: str) -> str:
    return rf"IF({i} < 0, NULL, get(split({s}, concat(r'\Q', {d}, r'\E'), -1), {i}))"


@translate("STR_TO_MAP")
def _str_to_map(s: str, pairs: str = "','", values: str = "'='") -> str:
    return rf"str_to_map({s}, concat(r'\Q', {pairs}, r'\E'), concat(r'\Q', {values}, r'\E'))"


@translate("IS_ALPHA")
def _is_alpha(x: str) -> str:
    return f"(CAST({x} AS STRING) rlike '^[A-Za-z]+$')"


@translate("IS_DECIMAL")
def _is_decimal(x: str) -> str:
    return f"(CAST({x} AS STRING) rlike '^[+-]?[0-9]+([.][0-9]+)?$')"


@translate("IS_DIGIT")
def _is_digit(x: str) -> str:
    return f"(CAST({x} AS STRING) rlike '^[0-9]+$')"


@translate("HASH_COLUMNS")
def _hash_columns(*a: str) -> str:
    return f"sha2(to_json(struct({', '.join(f'{x} AS c{i}' for i, x in enumerate(a))}), map('ignoreNullFields', 'false')), 256)"


# ---- time


@translate("CONVERT_TZ")
def _convert_tz(s: str, source: str, target: str) -> str:
    return f"date_format(convert_timezone({source}, {target}, CAST({s} AS TIMESTAMP_NTZ)), 'yyyy-MM-dd HH:mm:ss')"


@translate("DATE_FORMAT")
def _date_format(x: str, pattern: str) -> str:
    return f"date_format(try_cast({x} AS TIMESTAMP_NTZ), {pattern})"


@translate("TO_TIMESTAMP")
def _to_timestamp(s: str, pattern: str = "'yyyy-MM-dd HH:mm:ss'") -> str:
    return f"CAST(try_to_timestamp({s}, {pattern}) AS TIMESTAMP_NTZ)"


@translate("TO_TIMESTAMP_LTZ")
def _to_timestamp_ltz(x: str, precision: str = "3") -> str:
    if precision.startswith("'"):
        return f"try_to_timestamp({x}, {precision})"
    return f"timestamp_seconds({x})" if precision.strip() == "0" else f"timestamp_millis({x})"


@translate("TO_DATE")
def _to_date(s: str, pattern: str = "'yyyy-MM-dd'") -> str:
    return f"CAST(try_to_timestamp({s}, {pattern}) AS DATE)"


@translate("TEMPORALOVERLAPS")
def _overlaps(s1: str, e1: str, s2: str, e2: str) -> str:
    return f"({s1} < {e2} AND {s2} < {e1})"


# ---- arrays and maps


@translate("ELEMENT")
def _element(a: str) -> str:
    return f"IF(size({a}) > 1, raise_error('ELEMENT of an array with more than one element'), get({a}, 0))"


@translate("ARRAY_SLICE")
def _array_slice(a: str, start: str, end: str | None = None) -> str:
    first = f"CASE WHEN {start} < 0 THEN greatest(size({a}) + {start} + 1, 1) ELSE greatest({start}, 1) END"
    last = f"size({a})" if end is None else f"CASE WHEN {end} < 0 THEN size({a}) + {end} + 1 ELSE least({end}, size({a})) END"
    return f"slice({a}, {first}, greatest(({last}) - ({first}) + 1, 0))"


@translate("ARRAY_SORT")
def _array_sort(a: str, ascending: str = "TRUE", null_first: str | None = None) -> str:
    plain = f"sort_array({a}, {ascending})"
    if null_first is None:
        return plain
    # nulls are put where they are asked for, whatever the direction
    nulls, rest = f"filter({a}, x -> x IS NULL)", f"sort_array(filter({a}, x -> x IS NOT NULL), {ascending})"
    return f"IF({null_first}, concat({nulls}, {rest}), concat({rest}, {nulls}))"


@translate("ARRAY_REMOVE")
def _array_remove(a: str, x: str) -> str:
    return f"filter({a}, e -> NOT (e <=> {x}))"


# ---- aggregates: DISTINCT comes as a prefix of the first argument


def _distinct(x: str) -> tuple[bool, str]:
    head, _, rest = x.partition(" ")
    return (True, rest) if head.upper() == "DISTINCT" else (False, x)


@translate("ARRAY_AGG")
def _array_agg(x: str) -> str:
    distinct, x = _distinct(x)
    return f"transform(array_sort({'collect_set' if distinct else 'collect_list'}(struct({x} AS v))), s -> s.v)"


@translate("COLLECT")
def _collect(x: str) -> str:
    distinct, x = _distinct(x)
    return f"array_sort({'collect_set' if distinct else 'collect_list'}({x}))"


@translate("LISTAGG")
def _listagg(x: str, separator: str = "','") -> str:
    distinct, x = _distinct(x)
    return f"nullif(array_join(array_sort({'collect_set' if distinct else 'collect_list'}(CAST({x} AS STRING))), {separator}), '')"


# ---- JSON text


def json_of(x: str) -> str:
    """SQL: a value of any type as JSON text, ``null`` for NULL."""
    whole = f"to_json(array({x}))"
    return f"substring({whole}, 2, length({whole}) - 2)"


@translate("JSON_QUOTE", "JSON_STRING")
def _json_quote(x: str) -> str:
    return f"IF({x} IS NULL, NULL, {json_of(x)})"


@translate("JSON_UNQUOTE")
def _json_unquote(x: str) -> str:
    return f"coalesce(try_variant_get(try_parse_json({x}), '$', 'string'), {x})"


@translate("JSON_VALUE")
def _json_value(j: str, path: str, returning: str = "string") -> str:
    return f"try_variant_get(try_parse_json({j}), {path}, '{returning}')"


@translate("JSON_QUERY")
def _json_query(j: str, path: str) -> str:
    return f"to_json(try_variant_get(try_parse_json({j}), {path}, 'variant'))"


@translate("JSON_EXISTS")
def _json_exists(j: str, path: str) -> str:
    return f"(try_variant_get(try_parse_json({j}), {path}, 'variant') IS NOT NULL)"


@translate("IS_JSON")
def _is_json(x: str) -> str:
    return f"(try_parse_json({x}) IS NOT NULL)"


@translate("JSON_ARRAY")
def _json_array(*a: str) -> str:
    return f"concat('[', concat_ws(',', {', '.join(json_of(x) for x in a)}), ']')" if a else "'[]'"


@translate("JSON_OBJECT")
def _json_object(*a: str) -> str:
    """Keys and values in turn."""
    return f"to_json(named_struct({', '.join(a)}), map('ignoreNullFields', 'false'))" if a else "'{}'"


@translate("JSON_ARRAYAGG")
def _json_arrayagg(x: str) -> str:
    return f"to_json(collect_list({x}))"


@translate("JSON_OBJECTAGG")
def _json_objectagg(k: str, v: str) -> str:
    return f"to_json(map_from_entries(collect_list(struct({k}, {v}))))"


# ---- JSONB is Spark's VARIANT


@translate("TO_JSONB")
def _to_jsonb(x: str) -> str:
    return f"try_parse_json(get_json_object(to_json(struct({x} AS v)), '$.v'))"


@translate("JSONB_OBJECT")
def _jsonb_object(*a: str) -> str:
    return f"parse_json({_json_object(*a)})"


@translate("JSONB_ARRAY")
def _jsonb_array(*a: str) -> str:
    return f"parse_json({_json_array(*a)})"


@translate("JSONB_CONCAT")
def _jsonb_concat(a: str, b: str) -> str:
    return f"to_variant_object(map_concat(CAST({a} AS MAP<STRING, VARIANT>), CAST({b} AS MAP<STRING, VARIANT>)))"


@translate("JSONB_EXISTS")
def _jsonb_exists(j: str, path: str) -> str:
    return f"(try_variant_get({j}, {path}, 'variant') IS NOT NULL)"


@translate("JSONB_EXTRACT")
def _jsonb_extract(j: str, path: str, default: str | None = None) -> str:
    if default is None:
        return f"try_variant_get({j}, {path}, 'string')"
    d = default.strip()
    kind = "string" if d[:1] in "'r" else "boolean" if d.upper() in ("TRUE", "FALSE") else "bigint" if d.lstrip("-").isdigit() else "double"
    return f"coalesce(try_variant_get({j}, {path}, '{kind}'), {default})"


@translate("JSONB_QUERY")
def _jsonb_query(j: str, path: str) -> str:
    return f"to_json(try_variant_get({j}, {path}, 'variant'))"


@translate("JSONB_TO_STRING")
def _jsonb_to_string(j: str) -> str:
    return f"to_json({j})"


@translate("JSONB_ARRAY_AGG")
def _jsonb_array_agg(x: str) -> str:
    return f"parse_json({_json_arrayagg(x)})"


@translate("JSONB_OBJECT_AGG")
def _jsonb_object_agg(k: str, v: str) -> str:
    return f"parse_json({_json_objectagg(k, v)})"


# ---- vectors are arrays of doubles


@translate("DOUBLE_TO_VECTOR", "VECTOR_TO_DOUBLE")
def _vector(x: str) -> str:
    return f"CAST({x} AS ARRAY<DOUBLE>)"


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"


@translate("COSINE_SIMILARITY")
def _cosine_similarity(a: str, b: str) -> str:
    return f"({_dot(a, b)} / nullif(sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}), 0D))"


@translate("COSINE_DISTANCE")
def _cosine_distance(a: str, b: str) -> str:
    return f"(1 - {_cosine_similarity(a, b)})"


@translate("EUCLIDEAN_DISTANCE")
def _euclidean(a: str, b: str) -> str:
    return f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> pow(CAST(x AS DOUBLE) - CAST(y AS DOUBLE), 2)), 0D, (s, x) -> s + x))"


@translate("CENTER")
def _center(v: str, dim: str) -> str:
    """Element-wise mean; the dimension is known, so each element is a partial aggregate of its own."""
    return "array(" + ", ".join(f"avg({v}[{i}])" for i in range(int(dim))) + ")"


# ---- text search


def stems(text: str) -> str:
    """SQL: the words of a text in lower case, common English endings cut."""
    ending = "'(?<=[a-z]{3})(?:ing|edly|ed|ly|ies|es|s)$'"
    return f"transform(filter(split(lower({text}), r'[^\\p{{L}}\\p{{N}}]+'), w -> w <> ''), w -> regexp_replace(w, {ending}, ''))"


@translate("TEXT_SEARCH")
def _text_search(query: str, *columns: str) -> str:
    """Over 0 if the columns have every word of the query; higher the larger the words' share of the text is."""
    text = f"concat_ws(' ', {', '.join(columns)})"
    wanted, there = f"array_distinct({stems(query)})", stems(text)
    found = f"size(filter({there}, w -> array_contains({wanted}, w)))"
    return f"IF(size({wanted}) > 0 AND size(array_except({wanted}, {there})) = 0, {found} / (1D + ln(1 + size({there}))), 0D)"
