import difflib
import random

import pytest

from tidemark.llm.line_dedup import MIN_WORDS, common_blocks, dedup_lines, line_hashes, patience, without_blocks
from .conftest import WORDS


def line(rng, n=12):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(n))


def test_patience_aligns_equal_lines_in_order():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randrange(1, 12) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))


def test_patience_finds_whole_blocks_of_unique_lines():
    rng = random.Random(1)
    for _ in range(100):
        block = rng.sample(range(1000, 2000), 8)
        a = rng.sample(range(100), 6) + block + rng.sample(range(100, 200), 5)
        b = rng.sample(range(200, 300), 9) + block + rng.sample(range(300, 400), 3)
        want = [m for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        assert patience(a, b) == [(m.a + k, m.b + k) for m in want for k in range(m.size)]


def test_long_texts_align_in_little_more_than_linear_time():
    rng = random.Random(2)
    a = list(range(1, 200_001))
    b = [x for x in a if rng.random() < 0.9] + rng.sample(a, 1000)
    pairs = patience(a, b)
    assert len(pairs) > 150_000 and all(a[i] == b[j] for i, j in pairs)


def test_short_runs_stay():
    a, w = line_hashes("one two\nthree four\nfive six")
    assert common_blocks(a, a, w, 6) == [0, 1, 2] and common_blocks(a, a, w, 7) == []


def test_a_passage_whose_lines_are_older_finds_its_holder(spark):
    rng = random.Random(9)
    x, y = line(rng, 25), line(rng, 25)
    rows = [(1, f"{line(rng)}\n{x}"), (2, f"{y}\n{line(rng)}"), (3, f"{line(rng)}\n{x}\n{y}"), (4, f"{x}\n{y}\n{line(rng)}")]
    got = {r["doc_id"]: r["text"] for r in without_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows[:3]) | {4: rows[3][1].split("\n")[2]}


def test_decoys_that_hold_the_lines_one_by_one_hide_no_block(spark):
    rng = random.Random(12)
    block = [line(rng, 15) for _ in range(5)]
    rows = [(i, f"{line(rng)}\n{x}\n{line(rng)}") for i, x in enumerate(block)]
    rows += [(i, "\n".join([line(rng), *block, line(rng)])) for i in (100, 101)]
    got = {r["doc_id"]: r["_deleted"] for r in without_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 5 if i == 101 else 0 for i, _ in rows}


def brute_deletions(rows, min_words):
    """Each document's lines in a run of equal adjacent lines with an earlier document, by all pairs of places."""
    split = {i: [x.strip() for x in t.split("\n")] for i, t in sorted(rows)}
    out = {}
    for i, b in split.items():
        gone = set()
        for a in (a for k, a in split.items() if k < i):
            for x, y in ((x, y) for x in range(len(a)) for y in range(len(b)) if a[x] == b[y] and (x == 0 or y == 0 or a[x - 1] != b[y - 1])):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                    n += 1
                if sum(len(v.split()) for v in b[y : y + n]) >= min_words:
                    gone |= set(range(y, y + n))
        out[i] = gone
    return out


def test_recall_against_all_pairs_of_places(spark):
    """300 documents with shared blocks, their parts and decoy lines: every repeated run, and nothing else; the figures are in the README."""
    rng = random.Random(13)
    blocks = [[line(rng, rng.randrange(6, 22)) for _ in range(rng.randrange(2, 7))] for _ in range(40)]
    rows = []
    for i in range(300):
        parts = [line(rng) for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(0, 4)):
            block = rng.choice(blocks)
            start = rng.randrange(len(block))
            part = rng.choice([block, block[start:], block[: start + 1], [rng.choice(block)]])
            parts += [*part, *(line(rng) for _ in range(rng.randrange(0, 3)))]
        rows.append((i, "\n".join(parts)))
    got = {r["doc_id"]: r["text"].split("\n") for r in without_blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = brute_deletions(rows, MIN_WORDS)
    total = found = extra = 0
    for i, t in rows:
        before = t.split("\n")
        # places by the lines that stay: all lines of a document are told apart but for blocks that it has twice
        kept, gone = iter(got[i]), set()
        nxt = next(kept, None)
        for k, x in enumerate(before):
            if x == nxt:
                nxt = next(kept, None)
            else:
                gone.add(k)
        total, found, extra = total + len(want[i]), found + len(want[i] & gone), extra + len(gone - want[i])
    print(f"recall {found / total:.4f} of {total} lines, {extra} others")
    assert total > 300 and found >= 0.99 * total and extra == 0


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    passage = [line(rng) for _ in range(6)]
    long_line = line(rng, 70)
    rows = [(i, "\n".join([*(line(rng) for _ in range(4)), *passage, line(rng)])) for i in range(0, 40, 4)]
    rows += [(i, "\n".join([line(rng), long_line, line(rng)])) for i in range(1, 40, 4)]
    rows += [(i, "\n".join(line(rng) for _ in range(8))) for i in range(2, 40, 4)]
    return rows, passage, long_line


def test_repeated_passages_stay_once_and_clean_documents_whole(spark, corpus):
    rows, passage, long_line = corpus
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    with_passage, with_line = [i for i, t in got.items() if passage[2] in t], [i for i, t in got.items() if long_line in t]
    assert (with_passage, with_line) == ([0], [1])
    for i, t in rows:
        if i % 4 == 2:
            assert got[i] == t
        elif i > 1:
            dropped = set(passage) if i % 4 == 0 else {long_line}
            assert got[i] == "\n".join(x for x in t.split("\n") if x not in dropped)


def test_every_deleted_line_is_still_in_an_earlier_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    after = {r["doc_id"]: r["text"] or "" for r in without_blocks(docs).collect()}
    assert set(after) == set(before)
    everything = {x.strip() for t in after.values() for x in t.split("\n")}
    assert {x.strip() for t in before.values() for x in t.split("\n") if x.strip()} <= everything


def test_a_hot_block_makes_pairs_with_its_first_document_only(spark):
    rng = random.Random(9)
    block = "\n".join(line(rng) for _ in range(5))
    df = spark.createDataFrame([(i, f"{line(rng)}\n{block}\n{line(rng)}") for i in range(2000)], "doc_id long, text string").repartition(8)
    out = without_blocks(df)
    assert out.filter("_deleted = 5").count() == 1999 and out.filter("doc_id = 0 AND _deleted = 0").count() == 1


def test_edge_cases(spark, wide, empty, rows):
    out = without_blocks(wide)
    assert out.count() == len(rows) and out.drop("_deleted").columns == [c for c in wide.columns]
    texts = {(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()}
    assert {(0, None), (1, ""), (2, " \n\t ")} <= texts
    assert dedup_lines(empty).count() == 0
    assert dedup_lines(spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")).count() == 2
