"""Operator 2: toxic spans by a linear-chain conditional random field.

Labels are of documents, so token labels are derived first: a word or word beginning
that is significantly tied to toxic documents, and nearly only found in them, marks the
tokens of toxic documents that have it; tokens of other documents are clean. The
field has two states (clean, toxic), weights for a token's word, beginnings and ending,
and a transition matrix; it is fitted by Adagrad on its likelihood, whose gradient
comes from the forward-backward marginals. A document is tagged whole by
forward-backward; the marginals give its offending offsets, and their sum and maximum
give its score through a logistic calibration on the training documents.

The model is fitted on the driver on a bounded sample of labelled rows (`SAMPLE` of each
label, texts of at most `SAMPLE_BYTES`, the lowest hashes of the ids); every document is
scored, whole, in one pass without a shuffle.

Defined cases: null and empty texts have no tokens, no spans and the score of a clean
text; a null label isn't used; of equal texts the label of the smallest doc_id counts,
of a doc_id with both labels the clean one; without labels of both kinds all scores are 0;
repeated rows get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_of

#: Labelled documents of each label that the model is fitted on, and their longest text in bytes.
SAMPLE = 2000
SAMPLE_BYTES = 32_768
#: Tokens of a training sequence.
SPAN = 64
#: Training sequences at most, chosen evenly among those without a toxic token.
SPANS = 8_000
PREFIXES = (3, 4, 5, 6)
CACHE_WORDS = 400_000
_EDGES = re.compile(r"^\W+|\W+$")
_TOKEN = re.compile(r"\S+")


def features(word: str) -> list[str]:
    """Of a token: its word without outer punctuation, beginnings and ending, in lower case."""
    w = _EDGES.sub("", word.lower())
    return ["w" + w, *("p" + w[:n] for n in PREFIXES if len(w) > n), "s" + w[-3:]] if w else ["w"]


@dataclass
class Field:
    """Feature weights of the toxic state, transition scores (from, to), and the calibration of document scores."""

    weights: dict[str, float]
    transitions: np.ndarray
    calibration: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def token_score(self, word: str) -> float:
        return self.weights.get("", 0.0) + sum(self.weights.get(f, 0.0) for f in features(word))

    def marginals(self, odds: list[float]) -> np.ndarray:
        """P(toxic) of each token by forward-backward; ``odds``: exp of the token scores."""
        (t00, t01), (t10, t11) = np.exp(self.transitions).tolist()
        forward = list(accumulate(odds[1:], lambda f, x: x * (t01 + t11 * f) / (t00 + t10 * f), initial=odds[0]))
        backward = list(accumulate(odds[:0:-1], lambda b, x: (t10 + t11 * x * b) / (t00 + t01 * x * b), initial=1.0))
        both = np.array(forward) * np.array(backward)[::-1]
        return both / (1 + both)

    def document_score(self, marginals: np.ndarray) -> float:
        a, b, c = self.calibration
        total, most = evidence(marginals)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * total + c * most))))


def evidence(marginals: np.ndarray) -> tuple[float, float]:
    if not len(marginals):
        return 0.0, 0.0
    return math.log1p(float(marginals[marginals > 0.05].sum())), float(marginals.max())


def marking(docs: list[tuple[list[str], int]]) -> set[str]:
    """Features tied to toxic documents: a likelihood ratio beyond chance among all features, and 95 % precision."""
    seen = [Counter(), Counter()]
    known: dict[str, list[str]] = {}
    for words, toxic in docs:
        own = set(words)
        known.update((w, [f for f in features(w) if f[0] != "s"]) for w in own if w not in known)
        seen[toxic].update({f for w in own for f in known[w]})
    n = [sum(1 for _, t in docs if t == k) for k in (0, 1)]
    bar = 2 * math.log(max(2, len(seen[0] | seen[1]))) + 8
    out = set()
    for f, k in seen[1].items():
        j = seen[0][f]
        p, q, r = k / n[1], j / n[0], (k + j) / (n[0] + n[1])
        if p <= 0 or p / (p + q) < 0.95:
            continue
        log = lambda x, of, rate: x * math.log(rate) + (of - x) * math.log(1 - rate) if 0 < rate < 1 else 0.0
        if 2 * (log(k, n[1], p) + log(j, n[0], q) - log(k, n[1], r) - log(j, n[0], r)) > bar:
            out.add(f)
    return out


def fit(texts: list[str], labels: list[int], epochs: int = 6) -> Field:
    """The field of labelled texts."""
    docs = [(t.split(), y) for t, y in zip(texts, labels, strict=True)]
    if len(set(labels)) < 2:
        return Field({}, np.zeros((2, 2)), (-30.0, 0.0, 0.0))
    marks = marking(docs)
    kinds: Counter = Counter()
    cached: dict[str, tuple[list[str], bool]] = {}

    def known(word: str) -> tuple[list[str], bool]:
        if word not in cached:
            fs = features(word)
            cached[word] = fs, any(f in marks for f in fs)
        return cached[word]

    spans = [[], []]
    for words, toxic in docs:
        for at in range(0, len(words), SPAN):
            span = [known(w) for w in words[at : at + SPAN]]
            tags = [bool(toxic and m) for _, m in span]
            spans[any(tags)].append(([f for f, _ in span], tags))
    step = max(1, len(spans[0]) // max(1, SPANS - len(spans[1])))
    used = spans[1][:SPANS] + spans[0][::step]
    for fs, _ in used:
        kinds.update(f for token in fs for f in token)
    index = {f: i + 1 for i, f in enumerate(sorted(f for f, k in kinds.items() if k >= 3))}
    width = len(PREFIXES) + 3
    ids = np.full((len(used), SPAN, width), len(index) + 1, np.int32)  # the last weight stays 0
    tags, there = np.zeros((len(used), SPAN), bool), np.zeros((len(used), SPAN), bool)
    for i, (fs, ys) in enumerate(used):
        tags[i, : len(ys)], there[i, : len(ys)] = ys, True
        for j, token in enumerate(fs):
            at = [0, *(index[f] for f in token if f in index)]
            ids[i, j, : len(at)] = at
    weights, squares = np.zeros(len(index) + 2), np.full(len(index) + 2, 1e-2)
    weights[0] = -2.0
    trans, trans_squares = np.zeros((2, 2)), np.full((2, 2), 1e-2)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(used))
        for at in range(0, len(order), 1000):
            rows = order[at : at + 1000]
            x, y, on = ids[rows], tags[rows], there[rows]
            score = np.where(on, weights[x].sum(axis=2), 0.0)
            post, both = _posteriors(score, trans, on)
            grad = np.bincount(x[on].ravel(), np.repeat((y - post)[on], width), len(weights)) / len(rows)
            grad[-1] = 0
            grad[:-1] -= 1e-5 * weights[:-1]
            squares += grad**2
            weights += 0.5 * grad / np.sqrt(squares)
            seen = np.zeros((2, 2))
            pairs = on[:, 1:]
            np.add.at(seen, (y[:, :-1][pairs].astype(int), y[:, 1:][pairs].astype(int)), 1)
            step_t = (seen - both) / len(rows)
            trans_squares += step_t**2
            trans = np.clip(trans + 0.2 * step_t / np.sqrt(trans_squares), -5, 5)
    model = Field({"": float(weights[0])} | {f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-3}, trans)
    model.calibration = _calibrated(model, docs)
    return model


def _posteriors(score: np.ndarray, trans: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) at each place, and the expected transitions over all pairs of places that are both there."""
    x, t = np.exp(np.clip(score, -30, 30)), np.exp(trans)
    n, m = score.shape
    state = np.stack([np.ones((n, m)), x], 2)
    f = np.empty((n, m, 2))
    f[:, 0] = state[:, 0]
    f[:, 0] /= f[:, 0].sum(1, keepdims=True)
    for i in range(1, m):
        f[:, i] = (f[:, i - 1] @ t) * state[:, i]
        f[:, i] /= f[:, i].sum(1, keepdims=True)
    b = np.ones((n, m, 2))
    for i in range(m - 2, -1, -1):
        nxt = (state[:, i + 1] * b[:, i + 1]) @ t.T
        b[:, i] = np.where(on[:, i + 1, None], nxt / nxt.sum(1, keepdims=True), 1.0)
    both = f * b
    post = both[:, :, 1] / both.sum(2)
    pair = f[:, :-1, :, None] * t * (state * b)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return post, pair[on[:, 1:]].sum(0)


def _calibrated(model: Field, docs: list[tuple[list[str], int]]) -> tuple[float, float, float]:
    """Logistic regression of the labels on the documents' evidence, both labels weighing the same."""
    seen: dict[str, float] = {}
    rows = []
    for words, _ in docs:
        odds = [seen[w] if w in seen else seen.setdefault(w, math.exp(max(-30.0, min(30.0, model.token_score(w))))) for w in words]
        rows.append((1.0, *evidence(model.marginals(odds) if odds else np.array([]))))
    x, y = np.array(rows), np.array([t for _, t in docs], float)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(3)
        beta += np.linalg.solve(h, x.T @ (share * (y - p)) - 1e-4 * beta)
    return tuple(beta.tolist())


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit on the sample of ``labels`` (doc_id, toxic), joined to ``docs``."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1))
    chosen = None
    for y in (0, 1):
        part = labels.filter(F.col("toxic") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    # at most 2 * SAMPLE ids are broadcast
    first = texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min(F.struct("doc_id", "toxic")).alias("x"))
    rows = sorted(first.select("x.doc_id", "text", "x.toxic").collect())
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def tag(docs: DataFrame, model: Field, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and the offending spans (start, end: code points) of each row."""
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    model_ = docs.sparkSession.sparkContext.broadcast(model)

    class Cache(dict):
        def __missing__(self, word: str) -> float:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = odds = math.exp(max(-30.0, min(30.0, model_.value.token_score(word))))
            return odds

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, field_ = Cache(), model_.value
        for batch in source:
            scores, spans = [], []
            for text in batch.column(1).to_pylist():
                odds = list(map(cache.__getitem__, text.split()))
                p = field_.marginals(odds) if odds else np.array([])
                scores.append(field_.document_score(p))
                spans.append(_runs(text, p > threshold) if (p > threshold).any() else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, spans_type)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(run, "doc_id long, score double, spans array<struct<start: int, end: int>>")


def _runs(text: str, toxic: np.ndarray) -> list[dict[str, int]]:
    """Offsets of runs of toxic tokens."""
    out: list[dict[str, int]] = []
    before = False
    for m, t in zip(_TOKEN.finditer(text), toxic.tolist(), strict=False):
        if t and before:
            out[-1]["end"] = m.end()
        elif t:
            out.append({"start": m.start(), "end": m.end()})
        before = t
    return out


def op2_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(docs, read(spark, sf_dir, "labels").filter(~held_out))
    tagged = tag(docs, model)
    return tagged.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
