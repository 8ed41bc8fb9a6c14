import random

import pytest


@pytest.fixture
def rnd():
    return random.Random(5)


@pytest.fixture(scope="session")
def words():
    r = random.Random(3)
    return ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8))) for _ in range(3000)]


@pytest.fixture
def documents(spark):
    """A function that makes a documents table of (doc_id, text[, source]) with clashing extra columns."""

    def make(rows):
        schema = "doc_id long, text string, source string, _id long, _hash string, _runs string, s long, start long, fp string, text_hash string, toks int, n int"
        full = [(r[0], r[1], r[2] if len(r) > 2 else "web", 1, "h", "r", 7, 8, "f", "t", 3, 4) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
