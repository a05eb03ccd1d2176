import random
import zlib

import numpy as np
import pytest

from tidemark.llm import toxicity
from tidemark.llm.queries import QUERIES
from tidemark.llm.toxicity import Field, features, fit, tag, train


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_marginals_are_those_of_all_tag_sequences():
    field = Field({}, np.array([[0.3, -0.8], [-0.4, 0.9]]))
    scores = [0.5, -1.0, 2.0, 0.1, -0.3]
    n, total, on = len(scores), 0.0, [0.0] * len(scores)
    for tags in range(1 << n):
        y = [tags >> i & 1 for i in range(n)]
        w = np.exp(sum(s for s, t in zip(scores, y, strict=True) if t) + sum(field.transitions[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        on = [o + w * t for o, t in zip(on, y, strict=True)]
    assert np.allclose(field.marginals(np.exp(scores).tolist()), [o / total for o in on])


def test_training_posteriors_match_the_taggers():
    rng = np.random.default_rng(0)
    score, trans = rng.normal(size=(1, 7)), rng.normal(size=(2, 2))
    post, pairs = toxicity._posteriors(score, trans, np.ones((1, 7), bool))
    assert np.allclose(post[0], Field({}, trans).marginals(np.exp(score[0]).tolist()))
    assert np.isclose(pairs.sum(), 6)


def made(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [f"nasty{rng.randrange(3)}", f"vile{rng.randrange(3)}!"]
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_spans_and_scores_of_held_out_texts(spark):
    model = fit(*made(400, 1))
    texts, labels = made(200, 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in tag(df, model).collect()}
    assert auc([(found[i]["score"], y) for i, y in enumerate(labels)]) > 0.98
    for i, y in enumerate(labels):
        inside = " ".join(texts[i][s["start"] : s["end"]] for s in found[i]["spans"])
        assert ("nasty" in inside and "vile" in inside) if y else not inside


def test_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op2_toxic_spans"](spark, sf).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert auc([(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]) > 0.9


def test_held_out_labels_and_other_columns_have_no_say(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], int(i % 2)) for i, r in enumerate(rows)], "doc_id long, toxic int")
    a = train(docs, labels)
    b = train(docs.drop("lang", "source", "n_chars"), labels.repartition(3))
    assert a.weights == b.weights and a.calibration == b.calibration


def test_equal_texts_with_opposite_labels_give_one_model(spark, monkeypatch):
    """The label of the smallest doc_id counts, however rows are dealt out."""
    import tidemark.llm.toxicity as t

    seen = []
    monkeypatch.setattr(t, "fit", lambda texts, labels: seen.append(sorted(zip(texts, labels, strict=True))))
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(20)] + [(30, "text 50"), (31, "text 50")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 7)) for i in range(20)] + [(30, 1), (30, 0), (31, 1)], "doc_id long, toxic int")
    for parts in (1, 3, 5):
        t.train(docs.repartition(parts), labels.repartition(parts))
    assert seen == [[(f"text {i}", 0) for i in range(7)][:5] + [("text 5", 0), ("text 50", 0), ("text 6", 0)]] * 3


@pytest.mark.parametrize("labels", [[], [(1, None)], [(1, 1), (2, 1)]])
def test_edge_cases(spark, wide, empty, labels):
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = train(wide, table)
    scores = tag(wide, model).collect()
    assert len(scores) == wide.count() and all(r["score"] < 0.5 for r in scores)
    assert tag(empty, model).count() == 0
    assert features("!!!") == ["w"]
