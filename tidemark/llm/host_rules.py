r"""Operator 6 [native]: quality rules with host-level verdicts.

Each document is measured (words, symbols, repeated lines, repeated three-word
windows) and tested against rules. Failures are counted by host; a host's failure
rate is shrunk towards the corpus's with a beta prior fitted by the moments of the
beta-binomial distribution and worth `MIN_WEIGHT` documents at least, so hosts aren't judged on
a few documents. The host's verdict decides about documents that fail one rule: a host whose
shrunken rate is at most ``max_rate`` is trusted and keeps them, the others lose them. A
document goes in any case if the base rules fail or two or more of the rules; one that fails
no rule is always kept. The bar is a rate and not a multiple of the corpus's, so that a corpus
of bad hosts isn't trusted for being even; a host with few documents is judged like the corpus.

Words are runs of non-space characters (ASCII space, \t to \r). The measures are
built-in array functions in one pass over the text; only the narrow measures are
written and aggregated. A hot host is summed on the map side, and the hosts' table
is broadcast only if its counted size allows, else joined with skew splitting.

Defined cases: null or empty text has no words and fails the base rules; a null host
counts as the host ''; repeated rows count once each; an empty table gives no rows; other
columns pass through ``keep_documents`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small, table, text_of, unused

MIN_WORDS = 50
#: A host is trusted with documents that fail one rule up to this shrunken failure rate.
MAX_RATE = 0.1
#: The prior counts as so many documents, at least and at most.
MIN_WEIGHT, MAX_WEIGHT = 20.0, 1e6

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rules of one document; base_failed is one more.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "n_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
    "repeats": "100 * n_repeat_words > 25 * n_words",
}
BASE_FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)"


def measured(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """``keep`` columns and MEASURES of each row."""
    keep = [F.col(c) for c in keep]
    df = docs.select(*keep, text_of(text).alias("_t"))
    df = df.select("*", F.expr(r"array_remove(split(_t, '[\\x20\\x09-\\x0D]+', -1), '')").alias("_w"), F.expr(r"filter(split(_t, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("_l"), F.expr("regexp_count(_t, '[#*$%&|<>]')").cast("long").alias("n_symbols"))
    df = df.select(*keep, "n_symbols", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.expr("IF(size(_w) < 3, array(), transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))").alias("_h"))
    # sorted with their places, equal windows are neighbours; texts without a repeated window skip this
    df = df.select("*", F.expr("IF(size(array_distinct(_h)) = size(_h), NULL, sort_array(transform(_h, (h, i) -> struct(h, i))))").alias("_s")).drop("_h")
    df = df.select("*", F.expr("sort_array(transform(filter(_s, (x, k) -> (k > 0 AND _s[greatest(k - 1, 0)].h = x.h) OR (k + 1 < size(_s) AND _s[least(k + 1, size(_s) - 1)].h = x.h)), x -> x.i))").alias("_p")).drop("_s")
    # each window adds the words that the one before it doesn't cover
    covered = F.expr("coalesce(aggregate(_p, struct(-3 AS last, 0L AS n), (a, p) -> struct(p AS last, a.n + least(3, p - a.last) AS n), a -> a.n), 0L)")
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines")


def prior_weight(hosts: int, rows: float | None, mean: float, squares: float | None, spread: float | None) -> float:
    """alpha + beta of the hosts' beta prior. ``squares``: sum of n^2, ``spread``: sum of k^2 / n over the hosts.

    The spread of the rates beyond what chance gives hosts of these sizes, as a share of the
    most that it could be, is 1 / (1 + alpha + beta).
    """
    if not 0 < mean < 1:
        return MAX_WEIGHT
    room = rows - squares / rows - (hosts - 1)
    share = ((spread - mean * mean * rows) / (mean * (1 - mean)) - (hosts - 1)) / room if room > 0 else 0.0
    return min(MAX_WEIGHT, max(MIN_WEIGHT, 1 / share - 1)) if share > 0 else MAX_WEIGHT


def judged(measures: DataFrame, host: str, max_rate: float = MAX_RATE) -> DataFrame:
    """A written table of measures with base_failed, failures, host_rate and kept."""
    failures = F.expr(" + ".join(f"CAST({rule} AS INT)" for rule in [BASE_FAILED, *(f"({r})" for r in RULES.values())]))
    df = measures.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("failures", failures).withColumn("_host", F.coalesce(F.col(host).cast("string"), F.lit("")))
    hosts = table(df.groupBy("_host").agg(F.count("*").alias("_n"), F.sum((F.col("failures") > 0).cast("long")).alias("_k")))
    n, k = F.col("_n").cast("double"), F.col("_k").cast("double")
    count, rows, failed, squares, spread = hosts.agg(F.count("*"), F.sum(n), F.sum(k), F.sum(n * n), F.sum(k * k / n)).first()
    mean = failed / rows if rows else 0.0
    weight = prior_weight(count, rows, mean, squares, spread)
    shrunken = (F.col("_k") + F.lit(weight * mean)) / (F.col("_n") + F.lit(weight))
    rates = hosts.select("_host", shrunken.alias("host_rate"))
    out = df.join(small(rates, 128), "_host").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & ~((F.col("failures") >= 2) | ((F.col("failures") == 1) & (F.col("host_rate") > max_rate))))


def keep_documents(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Rows are known by doc_id, host and a hash of the text; rows alike in these are judged alike."""
    mark = unused(docs.columns, "_hash")
    hashed = docs.withColumn(mark, F.xxhash64("text"))
    measures = table(measured(hashed, "text", "doc_id", host, mark))
    out = table(judged(measures, host, max_rate).filter(~F.col("kept")).select("doc_id", host, mark).distinct())
    same = hashed["doc_id"].eqNullSafe(out["doc_id"]) & hashed[host].eqNullSafe(out[host]) & (hashed[mark] == out[mark])
    return hashed.join(small(out, 64), same, "left_anti").drop(mark)


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = table(measured(read(spark, sf_dir, "documents"), "text", "doc_id", "source"))
    return judged(measures, "source").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_FAILS = " + ".join(f"CAST(({r}) AS INT)" for r in [BASE_FAILED, *RULES.values()])
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
t3 AS (SELECT doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, g FROM t3 GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM t3 JOIN dup USING (doc_id, g), (VALUES (0), (1), (2)) AS t(o) GROUP BY doc_id),
m AS (SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, {BASE_FAILED} AS base_failed, {_FAILS} AS failures FROM m),
h AS (SELECT host, count(*)::DOUBLE AS n, sum((failures > 0)::INT)::DOUBLE AS k FROM f GROUP BY host),
s AS (SELECT count(*) AS hosts, sum(n) AS r, sum(k) / sum(n) AS mean, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room, sum(k * k / n) AS spread FROM h),
g AS (SELECT mean, CASE WHEN mean > 0 AND mean < 1 AND room > 0 THEN ((spread - mean * mean * r) / (mean * (1 - mean)) - (hosts - 1)) / room ELSE 0 END AS share FROM s),
p AS (SELECT mean, CASE WHEN share > 0 THEN least({MAX_WEIGHT}, greatest({MIN_WEIGHT}, 1 / share - 1)) ELSE {MAX_WEIGHT} END AS weight FROM g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (failures >= 2 OR (failures = 1 AND (k + weight * mean) / (n + weight) > {MAX_RATE})) AS kept
FROM f JOIN h USING (host), p
"""
