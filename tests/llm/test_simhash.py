import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.simhash import keep_one_of_each, near_duplicates, simhash_components, trie_links


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def brute_fingerprint(text):
    hs = [xxhash.xxh64_intdigest(s.encode("utf-8"), 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(nodes, linked):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if linked(a, b):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {n: root(n) for n in nodes}


def test_fingerprints_and_components_match_brute_force(spark, sf, docs, rows):
    base = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    every = [(i + 10_000, t) for i, t in base] + [(r[0], r[1]) for r in rows]
    df = spark.createDataFrame(every, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash_components(df).collect()}
    prints = {i: brute_fingerprint(t) for i, t in every}
    want = brute_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: v[0] for i, v in got.items()} == prints
    assert {i: v[1] for i, v in got.items()} == want


@pytest.mark.parametrize("budget", [0, 1, 2])
def test_trie_links_connect_what_brute_force_links(budget):
    rng = np.random.default_rng(budget)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    keys = np.sort(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for c in centres]))
    links = trie_links(keys, 64, budget)
    assert all(int(keys[i] ^ keys[j]).bit_count() <= budget for i, j in links)
    values = {i: int(k) for i, k in enumerate(keys)}
    want = brute_components(values, lambda a, b: (values[a] ^ values[b]).bit_count() <= budget)
    mine = {frozenset(e) for e in links}
    assert brute_components(values, lambda a, b: frozenset((a, b)) in mine) == want


def test_groups_over_the_limit_are_dealt_out_without_loss(spark, monkeypatch):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = sorted({base ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40)) for _ in range(300)})
    nodes = {i: p for i, p in enumerate(prints)}
    want = brute_components(nodes, lambda a, b: (nodes[a] ^ nodes[b]).bit_count() <= 2)
    monkeypatch.setattr(simhash, "GROUP", 40)
    df = spark.createDataFrame([(1, i, p - (1 << 64) if p >> 63 else p) for i, p in nodes.items()], "key long, node long, proj long")
    edges = {frozenset((r["a"], r["b"])) for r in simhash.linked(df, 64, 2).collect()}
    assert brute_components(nodes, lambda a, b: frozenset((a, b)) in edges) == want


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(0, 4)):
            texts.append(edited(rng, words, rng.randrange(0, max(1, len(words) // 25))))
    texts += ["", None, "", "a b", "a b", "a c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = {i: set(shingles(t, 5)) for i, t in enumerate(texts)}
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = brute_components(sets, similar)
    got = {i: i for i in sets} | {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()}
    # no pair is linked that isn't similar; and hardly any similar one is missed
    assert all(want[i] == want[c] for i, c in got.items())
    later = [i for i in sets if want[i] != i]
    missed = [i for i in later if got[i] == i]
    assert len(later) > 40 and len(missed) <= 0.03 * len(later)


def test_copies_that_resemble_each_other_less_than_their_original(spark):
    """Pairs of copies are candidates that fail; they must not keep out the copies' pairs with the original."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(30000)}" for _ in range(200)]
    texts = [" ".join(words), *(edited(rng, words, 4) for _ in range(150))]
    sets = [set(shingles(t, 5)) for t in texts]
    assert all(len(s & sets[0]) >= 0.8 * len(s | sets[0]) for s in sets)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert near_duplicates(df).filter("component_id = 0").count() >= 148


def test_short_texts_and_chains(spark):
    """Figures in the README: texts of a few shingles, and chains in which only neighbours are similar."""
    rng = random.Random(8)
    texts, later = [], []
    for n in (9, 10, 11, 12, 14, 20, 40):
        for _ in range(60):
            words = [f"w{rng.randrange(20000)}" for _ in range(n)]
            later.append(len(texts) + 1)
            texts += [" ".join(words), " ".join(words[:-1])]
    for _ in range(40):
        words = [f"w{rng.randrange(20000)}" for _ in range(200)]
        for k in range(6):
            if k:
                later.append(len(texts))
            texts.append(" ".join(words))
            words = edited(rng, words, 4).split()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in near_duplicates(df).collect()}
    short = [i for i in later if len(texts[i].split()) < 12]
    print(f"short texts {len(got & set(short)) / len(short):.3f}, all {len(got & set(later)) / len(later):.3f}")
    assert got <= set(later) and set(short) <= got and len(got) >= 0.98 * len(later)


def test_dense_groups_of_near_copies(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = [edited(rng, words, 1) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_duplicates(df).filter("component_id = 0").count() >= 595


def test_keep_one_of_each_and_edge_cases(docs, wide, empty, rows):
    kept = keep_one_of_each(wide)
    assert kept.columns == wide.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {7, 5, 6, 0, 3, 4} <= set(ids) and not {8, 1, 2, 901} & set(ids)
    assert keep_one_of_each(empty).count() == 0 and simhash_components(empty).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (None, None), (2, "a b c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash_components(df).collect() if r["doc_id"]) == [(1, 1), (2, 1)]
    assert simhash_components(df).filter("doc_id IS NULL AND component_id IS NULL").count() == 2
    assert keep_one_of_each(df).count() == 3
