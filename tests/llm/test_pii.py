import hashlib
import random
import re
import time

import numpy as np
import pytest

from tidemark.llm.pii import FEATURES, KINDS, classifier, detect, estimate
from .conftest import prose


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text):
    out = []
    for kind in KINDS:
        for m in PLAIN[kind].finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


FIXED = [
    None, "", "write to a.b+c@x-y.co.uk. or a@b", "@@a@b.c@d.e", "a@b.c_x@d.e and z@b..c", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 001.02.3.255 0000300.1.1.1", "1.2.3.4.5", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 4111111111111111", "12345678901234567890123", "0" * 19 + " " + "0" * 20,
    "call +49 (30) 1234-5678. +1 2 3 and +1.800.555.0199x +123456789012345678", "++1 555 123 4567", "é🙂 mail: jörg@exämple.com me@example.com 字", "user [at] example [dot] com; a (at) b.org", "phone: (555) 123-4567 or 555.123.4567", "10[.]0[.]0[.]1", "4111 1111 1111 1111 4111 1111 1111 1111", "1-2-3-4 5--6  7", "\n+4930123456\n78", "5500 0000 0000 0004, 3400 000000 00009",
]


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(4)
    pieces = ["@", ".", "-", "+", " ", "a", "b.c", "x_y", "4111111111111111", "1", "22", "333", "0", "(", ")", "\n", "é", "🙂", "@b.co", "+49", "255.", "10.0.0.1", "%", "[at]", "5500 0000 0000 0004"]
    texts = FIXED + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(1500)] + [prose(rng, 20_000) + " me@example.com +49 30 1234567"]
    got = {r["doc_id"]: r for r in detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), repr(t)
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(s.startswith(k) for s in want) for k in KINDS]
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(want) <= set(spans) and len(spans) == len(set(spans)) == len(want) + got[i]["n_added"]
        order = [(KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"user{i}@mail.example.com 10.0.{i % 256}.1" for i in range(40_000))
    row = detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_email"], row["n_ip"]) == (40_000, 40_000)
    assert row["base_sha256"] == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()


def test_added_spans_are_personal_data_without_base_form(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 20) + f" Please mail person{i}@example.com or call +49 30 12345{i % 10}7 today. " + prose(rng, 20)) for i in range(300)]
    rows += [(1000 + i, prose(rng, 15) + f" contact: person{i} [at] example [dot] com please. " + prose(rng, 10)) for i in range(40)]
    rows += [(2000 + i, prose(rng, 15) + " token=555-123-4567x key 12 34 " + prose(rng, 10)) for i in range(40)]
    got = {r["doc_id"]: r for r in detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i]["n_added"] for i in range(1000, 1040)) >= 36
    assert sum(got[i]["n_added"] for i in range(2000, 2040)) == 0


def test_em_finds_reliable_labelers():
    rng = random.Random(1)
    counts = {}
    for _ in range(5000):
        true = rng.random() < 0.6
        votes = "".join(str(int(true if rng.random() < r else not true)) for r in (0.95, 0.9, 0.85, 0.55, 0.8))
        counts[votes] = counts.get(votes, 0) + 1
    post, rates = estimate(counts)
    assert rates[0][0] > 0.9 and rates[0][1] < 0.15 and rates[3][0] - rates[3][1] < 0.3


def test_the_classifier_learns_from_features_and_not_from_votes():
    rng = np.random.default_rng(2)
    true = rng.random(2000) < 0.3
    features = np.stack([np.where(true, rng.integers(0, 5, 2000), rng.integers(3, 8, 2000)), rng.integers(20, 40, 2000)], 1)
    weights = classifier(features, np.where(true, 0.9, 0.1), np.ones(2000))
    score = lambda *f: weights[list(f)].sum() + weights[FEATURES]
    assert score(0, 25) > 1.5 and score(7, 25) < -1.5 and abs(weights[20:40]).max() < 0.7


def planted(rng):
    """(text, personal spans without base form, other spans that look like them)."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: rng.choice(["ann", "bo.li", "c_d", "dora7"]) + n(2)
    good = [
        lambda: ("contact: ", f"{name()} [at] example{n(1)} [dot] com", " or so"),
        lambda: ("mail to ", f"{name()} (at) firm{n(1)}.org", " now"),
        lambda: ("phone ", f"({rng.randrange(200, 999)}) 555-{n(4)}", " today"),
        lambda: ("call ", f"{rng.randrange(200, 999)}-555-{n(4)}", ", please"),
        lambda: ("server ip ", f"10[.]{rng.randrange(255)}[.]{rng.randrange(255)}[.]{rng.randrange(1, 255)}", " was down"),
    ]
    bad = [lambda: (" token=", f"{n(3)}-{n(3)}-{n(4)}", "\""), lambda: (" parcel ", f"4{n(15)}", " sent"), lambda: (" key: ", f"{n(3)} {n(3)} {n(4)}", "_x")]
    base = [lambda: ("write to ", f"{name()}@example.com", " "), lambda: ("call ", f"+49 30 {n(7)}", " "), lambda: ("the host ", f"10.0.{rng.randrange(255)}.7", " ")]
    parts, spans, wrong, at = [], [], [], 0
    for makers, into in rng.sample([(good, spans), (bad, wrong), (base, None), (base, None)], 4):
        before, value, after = rng.choice(makers)()
        text = prose(rng, 8) + " " + before
        if into is not None:
            into.append((at + len(text), at + len(text) + len(value)))
        parts.append(text + value + after + " ")
        at += len(parts[-1])
    return "".join(parts), spans, wrong


def test_precision_and_recall_on_spans_without_base_form(spark):
    """Half of what a text holds beside base spans is personal; the figures are in the README."""
    rng = random.Random(11)
    cases = [planted(rng) for _ in range(1500)]
    got = {r["doc_id"]: r["spans"] for r in detect(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string").repartition(4)).collect()}
    hits = wrong = missed = 0
    for i, (text, spans, _) in enumerate(cases):
        base = set(base_spans(text))
        added = {tuple(map(int, x.split(":")[1:])) for x in got[i].split(",") if x and x not in base}
        hits, wrong, missed = hits + len(added & set(spans)), wrong + len(added - set(spans)), missed + len(set(spans) - added)
    print(f"precision {hits / (hits + wrong):.3f}, recall {hits / (hits + missed):.3f}")
    assert hits / (hits + wrong) >= 0.95 and hits / (hits + missed) >= 0.9


def test_a_long_text_of_candidates_takes_seconds(spark):
    text = " ".join(f"user{i} [at] mail.example [dot] com, other{i}@mail.example.com" for i in range(16_000))
    began = time.perf_counter()
    row = detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_email"] == 16_000 and time.perf_counter() - began < 40


def test_wide_forms_never_touch_base_spans(spark):
    texts = ["a@b.co [at] c.com", "x [at] c.com@d.org", "x [at] c.com_foo@b.org", "1.2.3.4[.]5[.]6[.]7", "1[.]2[.]3[.]4.5.6.7", "+1 (974) 555-3436 x", "(974) 555-3436+49 30 1234567", "a [at] b [dot] c.d@e.f"]
    got = {r["doc_id"]: r for r in detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(base_spans(t)) <= set(spans)
        for kind in KINDS:
            own = sorted(tuple(map(int, x.split(":")[1:])) for x in spans if x.startswith(kind))
            assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))


@pytest.mark.parametrize("name", ["wide", "docs"])
def test_edge_cases(request, empty, rows, name):
    df = request.getfixturevalue(name)
    assert detect(df).count() == len(rows)
    assert detect(empty).count() == 0
