import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm_score
from tidemark.llm.lm_score import _rows, ask, from_narrow, narrow, packed, score_documents, score_rows, tokenised, unpacked
from tidemark.llm.queries import QUERIES


def toks(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def brute_base(texts, training):
    counts = Counter(t for x in training for t in toks(x))
    n, v = sum(counts.values()), len(counts)
    return [(len(toks(t)), sum(counts[w] > 0 for w in toks(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in toks(t))) for t in texts]


@pytest.mark.parametrize(("many", "bucket"), [(False, 1 << 18), (True, 50)])
def test_counts_and_base_scores_match_brute_force(spark, docs, rows, monkeypatch, many, bucket):
    """Small blocks and buckets cut the automaton in many pieces."""
    monkeypatch.setattr(lm_score, "BUCKET", bucket)
    training = docs.filter("doc_id % 3 != 0")
    if many:
        docs, training = docs.repartition(9), training.repartition(7)
    got = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in score_documents(docs, training).collect())
    want = brute_base([r[1] for r in rows], [r[1] for r in rows if r[0] % 3])
    assert got == sorted((r[0], a, b, n, round(s, 6)) for r, (a, b, n, s) in zip(rows, want, strict=True))
    together = score_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 3 != 0).alias("trains"), F.lit(True).alias("scored")))
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in together.collect()) == got


def brute_model(train, mass):
    """p(token | two tokens before), by the definition, over all pairs and triples."""
    texts = [["<s>", *toks(x)] for x in train]
    counts, pairs, triples = (Counter(t for y in texts for t in zip(*(y[k:] for k in range(n)), strict=False)) for n in (1, 2, 3))
    del counts["<s>",]
    n, v = sum(counts.values()), len(counts)
    leaving, from_pair = Counter(p[0] for p in pairs.elements()), Counter(t[:2] for t in triples.elements())

    def p(token, before=None, before2=None):
        root = (counts[token,] + 1) / (n + v + 1)
        two = (pairs[before, token] + mass[0] * root) / (leaving[before] + mass[0])
        return two if before2 is None else (triples[before2, before, token] + mass[1] * two) / (from_pair[before2, before] + mass[1])

    return p, counts, pairs


TRAIN = ["a b a b c", "a b d", "e e e a b c", "", "a b c d a b c", "f", "f"]


@pytest.mark.parametrize("mass", [(3000.0, 5.0), (1.0, 1.0), (0.5, 20.0)])
@pytest.mark.parametrize("bucket", [1 << 18, 3])
def test_scores_follow_arcs_and_failures(spark, monkeypatch, mass, bucket):
    monkeypatch.setattr(lm_score, "BUCKET", bucket)
    texts = TRAIN + ["a b", "b a q", "z z a b c", "e e e e e", "c d a", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in score_documents(df, df.filter(f"doc_id < {len(TRAIN)}"), mass).collect()}
    p, counts, pairs = brute_model(TRAIN, mass)
    for i, t in enumerate(texts):
        y = [None, "<s>", *toks(t)]
        want = sum(math.log10(p(c, b, a)) for a, b, c in zip(y, y[1:], y[2:], strict=False))
        assert got[i] == pytest.approx(want, abs=1e-9)
    vocabulary = [*(w for w, in counts), "<unknown>"]
    for state in [(None, "<s>"), *[(None, w) for w, in counts if w != "\n"], *[x for x in pairs if x[1] != "\n"]]:
        assert sum(p(t, state[1], state[0]) for t in vocabulary) == pytest.approx(1)


def test_every_ngram_of_the_training_texts_is_in_the_model(spark, sf):
    """The hashes that blocks ask for, with their counts, are the corpus's n-grams, at any size."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    blocks = tokenised(_rows(docs, F.lit(True), True), 5000)
    assert blocks.count() > 5
    asked = ask(blocks, 7).collect()
    texts = [["<s>", *toks(r["text"])] for r in docs.select("text").collect()]
    for k in range(3):
        found = Counter()
        for r in asked:
            if r["bucket"] // 7 == k:
                found.update(dict(zip(unpacked(r["hashes"]).tolist(), from_narrow(r["times"]).tolist(), strict=True)))
        want = Counter(t for y in texts for t in zip(*(y[i:] for i in range(k + 1)), strict=False) if t != ("<s>",))
        assert sorted(found.values()) == sorted(want.values())


def test_packing_of_numbers():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        h = np.sort(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        assert unpacked(packed(h)).tolist() == h.tolist()
        for top in (0, 1, 255, 256, 70_000, 1 << 40):
            c = rng.integers(0, top + 1, n)
            assert from_narrow(narrow(c)).tolist() == c.tolist()


def test_query(spark, sf):
    got = QUERIES["op10_backoff_automaton"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_frequent_phrases_score_higher(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "the cat sat on the mat " * rng.randrange(1, 4)) for i in range(50)] + [(100, "the cat sat on the mat"), (101, "mat the on sat cat the")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in score_documents(df.filter("doc_id >= 100"), df.filter("doc_id < 100")).collect()}
    assert got[100]["base_score"] == pytest.approx(got[101]["base_score"]) and got[100]["score"] > got[101]["score"] + 3


def test_edge_cases(spark, wide, empty, rows):
    assert score_documents(empty, empty).count() == 0
    none = score_documents(wide, empty).collect()
    assert len(none) == len(rows) and all(r["score"] == 0 and r["train_tokens"] == 0 for r in none)
    assert score_documents(wide, wide).count() == len(rows)
