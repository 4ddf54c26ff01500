import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(seed=3, n=60):
    """Invented texts with copies, near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ten", "ru", "sha", "von", "é", "ß", "pri", "do", "gel"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = text(30)
    out = []
    for i in range(n):
        t = text(rng.randint(12, 120))
        if i % 7 == 3 and i > 7:
            t = out[rng.randrange(len(out))][1] or t
        elif i % 7 == 5 and i > 7:
            words = (out[rng.randrange(len(out))][1] or t).split(" ")
            words[rng.randrange(len(words))] = word()
            t = " ".join(words)
        elif i % 5 == 1:
            t = t + "\n" + shared + "\n" + text(10)
        out.append((i * 3 + 1, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None])))
    out += [(900, None, "en", "a"), (901, "", None, None), (902, "  \n\t ", "en", "a"), (903, "one", "en", "b"), (904, "One", "en", "b"), (905, text(3000), "en", "a"), (906, "aa " * 200, "en", "a"), (907, "x" * 300, "de", "b")]
    return [(a, b, c, d, len(b) if b is not None else None) for a, b, c, d in out]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, null ids, and columns whose names an operator might use itself."""
    return spark.createDataFrame(
        [(5, "same text here now again", "en", "a", 1, "x", 7), (5, "same text here now again", "en", "a", 1, "x", 7), (None, "same text here now again", None, None, None, None, None), (6, None, None, None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long, words string, id long",
    )
