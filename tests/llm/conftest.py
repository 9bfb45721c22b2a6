import pytest

DOCS = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (id, text) or (id, text, lang, source)."""

    def make(rows):
        return spark.createDataFrame([(*r, *("en", "s")[: 4 - len(r)]) if len(r) == 2 else r for r in rows], DOCS)

    return make


def words(seed, n, least=3):
    """A run of ``n`` invented words that depends on ``seed`` only."""
    import random

    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(least, 8))) for _ in range(n))][0]


@pytest.fixture(scope="session")
def text():
    return words
