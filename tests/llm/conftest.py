import random

import pytest

WORDS = "the of and a in to it is was that for on with as be at by this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also well".split()


def prose(rng: random.Random, n: int) -> str:
    """Words in sentences and lines."""
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", "ly", "ing", "er"]))
        if i % 13 == 12:
            out[-1] += "."
        if i % 40 == 39:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


def documents() -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars) with the cases that every operator must take."""
    rng = random.Random(5)
    texts: list = [None, "", " \n\t ", "one", "two words", "x" * 50_000, prose(rng, 30_000)]
    base = prose(rng, 200)
    texts += [base, base, base.replace("the", "thee", 1), base + " end"]
    texts += ["line one is here\n" * 40, "a b c " * 60, "é ü 字 🙂 naïve " + prose(rng, 60), "  odd spaces\x1cand\x85more", "tab\tsep\x0bvt\x0cff\rcr"]
    texts += [prose(rng, rng.randrange(5, 300)) for _ in range(24)]
    rows = [(i, t, "en" if i % 3 else None, "hot" if i % 3 else f"src{i % 4}", len(t) if t else 0) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (900, texts[20], "en", None, None), (901, texts[20], "en", None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = ("h", "key", "node", "count", "_t", "_w", "lines", "part", "first", "row", "token", "value", "spans", "score", "whole", "a", "b", "_lines", "_id", "component", "bins")


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def wide(docs):
    """The documents with columns of clashing names."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
