import itertools
import random

import pytest

from tidemark.llm.decontaminate import MASKS, Hashes, Index, clean_documents, contaminated, indexes, token_hashes, window_hashes
from .conftest import prose


def words(rng, n):
    return [f"tok{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(1)
    return [(i, " ".join(words(rng, n))) for i, n in enumerate([8, 13, 20, 40, 80, 150])] + [(90, None), (91, ""), (92, "!!! ???")]


@pytest.fixture(scope="module")
def benchmark_df(spark, bench):
    return spark.createDataFrame(bench, "item_id long, text string")


def test_one_substitution_anywhere_in_a_window_leaves_a_hit():
    for place in range(12):
        assert any(m[place] == "0" for m in MASKS)
    rng = random.Random(2)
    for _ in range(100):
        a = words(rng, 12)
        b = list(a)
        b[rng.randrange(12)] = "other"
        x, y = (token_hashes(" ".join(t), Hashes()) for t in (a, b))
        assert any(window_hashes(x, m)[0] == window_hashes(y, m)[0] for m in MASKS)


def test_passages_are_found_with_substitutions_and_clean_texts_are_not(spark, bench, benchmark_df):
    rng = random.Random(3)
    rows, want = [], {}
    for item, text in bench[:6]:
        toks = text.split()
        for k in range(6):
            part = list(toks)
            if len(toks) > 13:
                start = rng.randrange(0, len(toks) - 13 + 1) if k % 2 else 0
                part = part[start : start + max(13, len(toks) // 2)]
            for i in range(len(part) // 12):  # one in twelve
                part[i * 12 + rng.randrange(12)] = "changed"
            if k == 0:
                part = [w.upper() + "," for w in part]
            i = len(rows)
            rows.append((i, " ".join([*words(rng, 30), *part, *words(rng, 20)])))
            want[i] = item
    clean = [(1000 + i, " ".join(words(rng, 300))) for i in range(100)] + [(2000, None), (2001, ""), (2002, " ".join(bench[4][1].split()[:9]))]
    df = spark.createDataFrame(rows + clean, "doc_id long, text string").repartition(3)
    found = contaminated(df, benchmark_df).collect()
    hits = {(r["doc_id"], r["item_id"]) for r in found}
    assert hits == set(want.items())
    for r in found:
        assert r["n_equal"] >= 0.8 * r["n_tokens"]
        toks, item = dict(rows)[r["doc_id"]].split()[r["start"] : r["start"] + r["n_tokens"]], dict(bench)[r["item_id"]].split()
        assert any(sum(a.lower().strip(",") == b for a, b in zip(toks, item[s:], strict=False)) == r["n_equal"] for s in range(len(item)))
    kept = {r["doc_id"] for r in clean_documents(df, benchmark_df).collect()}
    assert kept == {i for i, _ in clean}


def test_a_short_run_doesnt_hide_a_long_one_on_its_diagonal():
    rng = random.Random(6)
    item = words(rng, 50)
    text = [*words(rng, 9), *item[:12], *(f"x{i}" for i in range(8)), *item[20:], *words(rng, 9)]
    h = lambda t: token_hashes(" ".join(t), Hashes())
    assert Index([(7, h(item))]).overlaps(h(text), 13, 0.8)[0][0] == 7


@pytest.mark.parametrize("length", [6, 10, 13, 14, 15, 16, 20])
def test_every_placement_of_substitutions_that_identity_admits_is_found(length):
    rng = random.Random(length)
    h = lambda t: token_hashes(" ".join(t), Hashes())
    item, around = words(rng, length), (words(rng, 30), words(rng, 30))
    index = Index([(1, h(item))])
    places = list(itertools.combinations(range(length), length // 5))
    for k in places if len(places) < 600 else rng.sample(places, 600):
        part = ["x" if i in k else w for i, w in enumerate(item)]
        found = index.overlaps(h([*around[0], *part, *around[1]]), 13, 0.8)
        assert [x[0] for x in found] == [1] and found[0][3] == length - len(k)
    every_fifth = ["x" if i % 5 == 4 else w for i, w in enumerate(item * 4)]
    assert length < 13 or Index([(1, h(item * 4))]).overlaps(h(every_fifth), 13, 0.8)


def test_regions_of_one_diagonal_are_each_extended():
    rng = random.Random(8)
    h = lambda t: token_hashes(" ".join(t), Hashes())
    item = words(rng, 70)
    for head in (item[:12], [f"y{i}" for i in range(12)]):
        text = [*head, *(f"x{i}" for i in range(20)), *item[32:62]]
        assert Index([(3, h(item))]).overlaps(h(text), 13, 0.8) == [(3, 32, 30, 30)]


def brute_contaminated(tokens, item, min_tokens, identity):
    """Whether any stretch of any diagonal has the identity, by all starts and ends."""
    least = min(min_tokens, len(item))
    for shift in range(least - len(item), len(tokens) - least + 1):
        lo, hi = max(0, shift), min(len(tokens), shift + len(item))
        sums = [0, *itertools.accumulate(int(tokens[i] == item[i - shift]) for i in range(lo, hi))]
        if any(sums[e] - sums[b] >= identity * (e - b) - 1e-9 for b in range(len(sums)) for e in range(b + least, len(sums))):
            return True
    return False


@pytest.mark.parametrize("seed", range(4))
def test_overlaps_match_all_stretches_of_all_diagonals(seed):
    """Random texts with one or two damaged regions of an item, often on one diagonal: the same contaminated set as by brute force."""
    rng = random.Random(seed)
    both = [0, 0]
    for _ in range(150):
        item = [f"t{rng.randrange(60)}" for _ in range(rng.randrange(6, 60))]
        text = [f"t{rng.randrange(60)}" for _ in range(rng.randrange(0, 15))]
        rate = rng.choice((0.0, 0.1, 0.2, 0.3))
        for _ in range(rng.randrange(0, 3)):
            start = rng.randrange(len(item))
            part = item[start : start + rng.randrange(5, 40)]
            text += [f"t{rng.randrange(60)}" if rng.random() < rate else w for w in part]
            text += [f"t{rng.randrange(60)}" for _ in range(rng.randrange(0, 25))]
        if rng.random() < 0.5:  # two regions in place
            text = [w if i % 30 < 12 or rng.random() > rate else "q" for i, w in enumerate(item)]
        x, y = (token_hashes(" ".join(t), Hashes()) for t in (text, item))
        want = brute_contaminated(text, item, 13, 0.8)
        assert bool(Index([(1, y)]).overlaps(x, 13, 0.8)) == want
        both[want] += 1
    assert min(both) > 20


def test_blocks_of_the_benchmark_give_the_same(spark, bench, benchmark_df, monkeypatch):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, " ".join([*words(rng, 5), *t.split(), *words(rng, 5)])) for i, t in bench[:6]], "doc_id long, text string")
    want = sorted(contaminated(df, benchmark_df).collect())
    import tidemark.llm.decontaminate as d

    small = lambda b, block_tokens=30: indexes(b, block_tokens)
    monkeypatch.setattr(d, "indexes", lambda b: small(b))
    assert sorted(contaminated(df, benchmark_df).collect()) == want
    assert clean_documents(df, benchmark_df).count() == 0


def test_edge_cases(spark, wide, empty, rows, benchmark_df):
    assert clean_documents(wide, benchmark_df).columns == wide.columns
    assert clean_documents(wide, benchmark_df).count() == len(rows)
    none = spark.createDataFrame([], "item_id long, text string")
    assert clean_documents(wide, none).count() == len(rows) and contaminated(wide, none).count() == 0
    assert clean_documents(empty, benchmark_df).count() == 0 and contaminated(empty, benchmark_df).count() == 0
    rng = random.Random(5)
    assert contaminated(spark.createDataFrame([(None, prose(rng, 50))], "doc_id long, text string"), benchmark_df).count() == 0
