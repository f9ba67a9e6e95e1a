import pytest

LONG, STR = "bigint", "string"
WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture
def docs(spark):
    """Builds a documents table, with columns whose names clash with the operators' own."""
    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), "x", 7, 3) for r in rows]
        return spark.createDataFrame(
            full, "doc_id bigint, text string, lang string, source string, kept string, rid bigint, size int").repartition(3)

    return make


@pytest.fixture
def text():
    """A reproducible text of n words."""
    def make(seed, n):
        import random

        r = random.Random(seed)
        return " ".join(r.choice(WORDS) for _ in range(n))

    return make
