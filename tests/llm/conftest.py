import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, words int, digest string, score string, row_id int, key string, pieces string, item string"


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]


@pytest.fixture(scope="session")
def prose(vocabulary):
    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def table(spark):
    """Documents with columns whose names the operators use inside."""

    def make(rows):
        full = [(i, t, "en", "src0", len(t or ""), True, 1, "d", "s", 7, "k", "p", "x") for i, t in rows]
        return spark.createDataFrame(full, KINDS)

    return make


@pytest.fixture(scope="session")
def odd(prose):
    """Nulls, empty and white texts, ties, repeated rows and ids, control characters, and a very long text."""
    long = prose(1, 60_000)
    return [(None, None), (None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "Tie  x"), (5, "Tie x "), (6, "tie x"), (7, prose(2, 80)), (7, prose(2, 80)), (8, prose(2, 80)), (9, "▁ </s> \0 \\ 🙂"), (10, long), (11, long + " end"), (12, "word " * 3000)]
