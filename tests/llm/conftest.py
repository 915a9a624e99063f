import random

import pytest

DOCS = "doc_id long, text string, kept string, seed int, item_id int"


@pytest.fixture()
def docs(spark):
    """Makes a documents table with extra columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented words, as many as asked for."""
    rng = random.Random(5)
    parts = ["ka", "ro", "mi", "len", "sta", "vo", "tu", "bre", "nis", "al"]

    def make(count):
        return [("".join(rng.choice(parts) for _ in range(rng.randrange(2, 5)))) for _ in range(count)]

    return make
