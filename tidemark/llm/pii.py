r"""Operator 4 [native]: personal data by weak supervision.

Base spans are the matches of four patterns that pass a check (octets, Luhn, digit
counts). They always stay. Candidates are wider: written-out addresses, numbers without a
country code, digit runs that fail the check, bracketed dots. Labelers vote on every span,
base or candidate: the base pattern, the format, a gazetteer of cue words before it,
the characters around it, and a cue of secrets, which votes against. Expectation-
maximisation over the counts of vote patterns of all documents estimates each labeler's
reliability for each kind. A logistic classifier for each kind then learns the posteriors from
what the labelers don't look at as such: the span's shape, length, digits and end, whether its
checksum holds, the words before it and the characters beside it, hashed to `FEATURES` places. It
is fitted on at most `SAMPLE` spans of a kind and side, the first by a hash, and scores every
candidate; those over `ACCEPT` are added.

Matching, voting and classifying are built-in expressions over one pass of the text;
what is written and counted is narrow. The vote patterns are at most 3^5 for each
kind, whatever the input; their counts and the sample come to the driver. Patterns are written so
that they scan a text in linear time: runs are possessive and start only where a run can. A
kind's base and wide forms are one pattern, so its matches never overlap.

Spans are ``kind:start:end`` in code points, end exclusive, by kind (email, ip, card,
phone) and start. Defined cases: null text is empty and has no spans; a span that
overlaps one of its kind is not added, nor one in a number that fails the base check; repeated
rows have equal spans; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, table, text_of

KINDS = ("email", "ip", "card", "phone")

#: Leftmost, non-overlapping; equal to the plain patterns with the checks, but linear (a run is entered at its start or where a match ended).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Other written forms. Where one touches a base form, the base form's match comes first or the wide one isn't tried.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?i:at)\x20?[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?(?i:dot)\x20?[\])]\x20?)[A-Za-z0-9-]++)++(?![A-Za-z0-9._%+-]*+@)",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}(?!\.?[0-9])",
    "phone": r"(?<![0-9+A-Za-z])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: SQL: whether a match ``x`` has the base form.
IS_BASE = {"email": "contains(x.v, '@')", "ip": "NOT contains(x.v, '[')", "card": "true", "phone": "startswith(x.v, '+')"}
#: A text without it has no match of either pattern.
NEEDS = {"email": r"[@\])]", "ip": r"[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}
CUES = {
    "email": r"(?i)e-?mail|mail|contact|write|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server|client|adresse|direcci",
    "card": r"(?i)card|visa|credit|debit|payment|karte|tarjeta|carte",
    "phone": r"(?i)phone|tel|call|fax|mobile|telefon|tel[eé]fono|llam|appel",
}
SECRET = r"(?i)(?:token|key|secret|password|id)\s*[=:]\s*[\x22\x27]?$"
FORMAT = {
    "email": r"(?i)(?:\.|dot\x20?[\])]\x20?)(?:com|net|org|edu|gov|io|de|fr|es|uk|eu|info)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])[.\[]",
    "card": r"^[3-6]",
    "phone": r"^\+?(?:[^0-9]*[0-9]){10,13}[^0-9]*$",
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}$"
#: Characters of context before and after a span.
BEFORE, AFTER = 24, 1
#: Matches whose offsets are summed in one go.
BLOCK = 64
_SPANS = "array<struct<s: int, e: int, v: string, b: string, a: string>>"
LABELERS = ("pattern", "format", "cue", "surround", "secret")
#: P(vote 1 | true) and P(vote 1 | false) of the base pattern, which aren't estimated: its checks are definitions, and one in ten numbers passes Luhn's.
PATTERN_RATES = (0.98, 0.1)
#: Candidates with a probability over this are added.
ACCEPT = 0.8
#: Places of hashed features, and spans of a kind and side (base or candidate) that the classifier is fitted on at most.
FEATURES, SAMPLE = 1024, 4000


def _match_columns(df: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a column for each of ``patterns`` (name: kind, pattern): the matches in ``t`` as (s, e, v, b, a), in order.

    ``b`` and ``a`` are up to `BEFORE` characters before and `AFTER` after the match, cut at its neighbours.
    Offsets are sums of the lengths of gaps and matches, summed in blocks of `BLOCK` matches and then over
    the blocks, so that a text with many matches doesn't copy its array for each of them.
    """
    for name, (kind, pattern) in patterns.items():
        p = f"r'{pattern}'"
        df = df.withColumn("_g", F.expr(f"IF(t rlike r'{NEEDS[kind]}', split(t, {p}, -1), array(''))"))
        df = df.withColumn("_h", F.expr(f"IF(size(_g) > 1, regexp_extract_all(t, {p}, 0), CAST(array() AS array<string>))"))
        df = df.withColumn("_p", F.expr(f"transform(_h, (h, i) -> named_struct('g', length(_g[i]), 'n', length(h), 'v', h, 'b', right(_g[i], {BEFORE}), 'a', left(_g[i + 1], {AFTER})))"))
        blocks = f"""IF(size(_p) = 0, CAST(array() AS array<struct<at: int, out: {_SPANS}>>), transform(sequence(0, (size(_p) - 1) div {BLOCK}), k -> aggregate(slice(_p, k * {BLOCK} + 1, {BLOCK}),
            named_struct('at', 0, 'out', CAST(array() AS {_SPANS})), (x, y) -> named_struct('at', x.at + y.g + y.n,
            'out', array_append(x.out, named_struct('s', x.at + y.g, 'e', x.at + y.g + y.n, 'v', y.v, 'b', y.b, 'a', y.a))))))"""
        df = df.withColumn("_k", F.expr(blocks))
        df = df.withColumn("_o", F.expr("aggregate(_k, array(0), (x, y) -> array_append(x, element_at(x, -1) + y.at))"))
        df = df.withColumn(name, F.expr("flatten(transform(_k, (y, i) -> transform(y.out, z -> named_struct('s', z.s + _o[i], 'e', z.e + _o[i], 'v', z.v, 'b', z.b, 'a', z.a))))"))
    return df.drop("_g", "_h", "_p", "_k", "_o")


def _luhn(value: str) -> str:
    """SQL: whether the digits of ``value`` pass Luhn's test."""
    return f"""aggregate(transform(split(reverse(regexp_replace({value}, '[^0-9]', '')), ''), (d, i) -> IF(i % 2 = 0, ascii(d) - 48,
        IF(ascii(d) > 52, 2 * (ascii(d) - 48) - 9, 2 * (ascii(d) - 48)))), 0, (a, d) -> a + d) % 10 = 0"""


CHECK = {
    "email": "true",
    "ip": f"x.v rlike r'{OCTETS}'",
    "card": _luhn("x.v"),
    "phone": "length(regexp_replace(x.v, '[^0-9]', '')) BETWEEN 9 AND 15",
}


def _features(kind: str) -> str:
    """SQL: places of the features of a match ``x``."""

    def beside(char: str) -> str:
        return rf"regexp_replace(regexp_replace({char}, r'[\p{{L}}]', 'a'), '[0-9]', '9')"

    named = [
        "left(regexp_replace(regexp_replace(x.v, '[0-9]+', '9'), '[A-Za-z]+', 'a'), 32)",
        "least(length(x.v), 40)",
        "length(regexp_replace(x.v, '[^0-9]', ''))",
        "left(x.v, 1)",
        r"lower(regexp_extract(x.v, '[A-Za-z]*$', 0))",
        r"regexp_extract(lower(x.b), r'([\p{L}]+)[^\p{L}]*$', 1)",
        r"regexp_extract(lower(x.b), r'([\p{L}]+)[^\p{L}]+[\p{L}]+[^\p{L}]*$', 1)",
        beside("right(x.b, 1)"),
        beside("x.a"),
        f"string({CHECK[kind]})" if kind == "card" else "''",
    ]
    return "array(" + ", ".join(f"int(pmod(xxhash64({i}, {f}), {FEATURES}))" for i, f in enumerate(named)) + ")"


def spans(docs: DataFrame) -> DataFrame:
    """Of each row: doc_id, the base spans and the candidates, both arrays of (kind, s, e, pattern, f): ``pattern`` being the labelers' votes, ``f`` the features."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    df = _match_columns(df, {f"m_{k}": (k, f"(?:{WIDE[k]})|(?:{BASE[k]})" if k in WIDE else BASE[k]) for k in KINDS}).drop("t")
    df = df.select("*", *[F.expr(f"filter(m_{k}, x -> {IS_BASE[k]} AND {CHECK[k]})").alias(f"b_{k}") for k in KINDS])
    df = df.select("*", *[F.expr(f"filter(m_{k}, x -> NOT ({CHECK[k] if k == 'card' else IS_BASE[k]}))").alias(f"c_{k}") for k in KINDS])

    def voted(kind: str, side: str, base: int) -> str:
        votes = rf"""concat({base}, IF(x.v rlike r'{FORMAT[kind]}', 1, 0), IF(x.b rlike r'{CUES[kind]}', 1, 2),
            IF(NOT x.b rlike r'[\p{{L}}0-9_=\x22]$' AND NOT x.a rlike r'[\p{{L}}0-9_\x22]', 1, 0), IF(x.b rlike r'{SECRET}', 0, 2))"""
        return f"transform({side}_{kind}, x -> named_struct('kind', {KINDS.index(kind)}, 's', x.s, 'e', x.e, 'pattern', {votes}, 'f', {_features(kind)}))"

    base = ", ".join(voted(k, "b", 1) for k in KINDS)
    # the base pattern has no say on other forms; what failed its check it votes against
    wide = ", ".join(voted(k, "c", 0 if k == "card" else 2) for k in KINDS)
    return df.select("doc_id", F.expr(f"concat({base})").alias("base"), F.expr(f"concat({wide})").alias("wide"))


def estimate(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """EM for one kind: ``counts`` of vote patterns -> posterior of each pattern, and each labeler's P(vote 1 | true), P(vote 1 | false).

    Votes are 1, 0 or 2 for none. It starts from the majority of votes.
    """
    post = {p: (p.count("1") + 0.5) / (p.count("1") + p.count("0") + 1) for p in counts}
    rates = [(0.5, 0.5)] * len(LABELERS)
    for _ in range(rounds):
        share = (sum(n * post[p] for p, n in counts.items()) + 1) / (sum(counts.values()) + 2)
        rates = []
        for j in range(len(LABELERS)):
            if j == 0:
                rates.append(PATTERN_RATES)
                continue
            sides = []
            for true in (True, False):
                w = {p: n * (post[p] if true else 1 - post[p]) for p, n in counts.items() if p[j] != "2"}
                # a labeler is better than chance, by a prior of four spans
                sides.append((sum(x for p, x in w.items() if p[j] == "1") + (3 if true else 1)) / (sum(w.values()) + 4))
            rates.append((sides[0], sides[1]))
        for p in post:
            log = math.log(share / (1 - share))
            for v, (t, f) in zip(p, rates, strict=True):
                log += math.log(t / f) if v == "1" else math.log((1 - t) / (1 - f)) if v == "0" else 0.0
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
    return post, rates


def classifier(features: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int = 300) -> np.ndarray:
    """Logistic regression of the posteriors ``target`` on rows of feature places; the last weight is the bias."""
    w, squares = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-8)
    x = np.concatenate([features, np.full((len(features), 1), FEATURES)], 1)
    share = weight / weight.sum()
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-w[x].sum(1)))
        grad = np.bincount(x.ravel(), np.repeat(share * (target - p), x.shape[1]), len(w)) - 1e-4 * np.append(w[:-1], 0)
        squares += grad**2
        w += 0.3 * grad / np.sqrt(squares)
    return w


def classifiers(found: DataFrame) -> dict[int, np.ndarray]:
    """The weights of each kind that has spans. ``found``: the written spans."""
    each = found.select(F.explode(F.concat("base", "wide")).alias("x")).select("x.*")
    both = each.groupBy("kind", "pattern").count().collect()
    out: dict[int, np.ndarray] = {}
    for kind in range(len(KINDS)):
        counts = {r["pattern"]: r["count"] for r in both if r["kind"] == kind}
        if not counts:
            continue
        post, _ = estimate(counts)
        rows = []
        for side in (F.col("pattern").startswith("1"), ~F.col("pattern").startswith("1")):
            total = sum(n for p, n in counts.items() if p.startswith("1") == (not rows))
            part = each.filter((F.col("kind") == kind) & side).orderBy(F.xxhash64("f", "s", "pattern"), "f", "s").limit(SAMPLE).select("pattern", "f").collect()
            rows.append([(r["f"], post[r["pattern"]], total / len(part)) for r in part])
        f, target, weight = (np.array(c) for c in zip(*rows[0], *rows[1], strict=True))
        out[kind] = classifier(f, target, weight)
    return out


def accepts(weights: dict[int, np.ndarray]) -> str:
    """SQL: whether the classifier of its kind accepts a candidate ``x``."""
    bar = math.log(ACCEPT / (1 - ACCEPT))
    by_kind = [f"WHEN {k} THEN aggregate(x.f, {w[-1]:.6f}D, (a, j) -> a + transform(split('{','.join(f'{v:.5g}' for v in w[:-1])}', ','), v -> CAST(v AS DOUBLE))[j]) > {bar:.6f}D" for k, w in weights.items()]
    return f"CASE x.kind {' '.join(by_kind)} ELSE false END" if by_kind else "false"


def _joined(spans_: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans_, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    found = table(spans(docs))
    added = F.expr(f"filter(wide, x -> {accepts(classifiers(found))})")
    counts = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.withColumn("added", added).select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def _is_kind(i: int):
    return lambda x: x["kind"] == i


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read(spark, sf_dir, "documents"))
