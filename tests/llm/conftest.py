import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _b string, rank string, k string"


def rows(pairs):
    """Documents with further columns whose names clash with those that operators use inside."""
    return [(i, t, "en", s, None, "b", "r", "k") for i, t, s in pairs]


@pytest.fixture(scope="session")
def documents(spark):
    """Small documents with nulls, empty and long texts, repeated rows and copies."""

    def make(pairs):
        return spark.createDataFrame(rows(pairs), DOCS)

    return make


@pytest.fixture(scope="session")
def odd():
    """(id, text, source)"""
    rng = random.Random(5)
    words = ["the", "of", "sana", "Milo", "éter", "rast", "quel", "onde", "ß", "日本"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    long = text(6000)
    base = text(60)
    out = [(1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "one", None), (5, long, "b"), (6, long, "b"), (7, base, "c"), (8, base + " more", "c"), (8, base + " more", "c"), (9, text(3), "Z"), (None, text(20), "a"), (10, "x" * 5000, "é")]
    out += [(20 + i, base, "hot") for i in range(30)]
    out += [(100 + i, text(rng.randrange(1, 80)), rng.choice("abc")) for i in range(60)]
    return out
