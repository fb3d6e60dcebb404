import sys
from pathlib import Path

import random  # noqa: E402

import pytest  # noqa: E402

sys.path.insert(0, str(Path(__file__).parent))

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta", "vo", "ri") for b in ("n", "r", "s", "t", "lan", "mer", "dor")]


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, blank and empty texts, repeated rows, a long text, and columns whose names operators use."""
    rows = [
        (1, " ".join(words(1, 40)), "en", "a"), (2, " ".join(words(1, 40)), "en", "b"), (3, " ".join(words(1, 40)) + " ", "en", None), (4, None, "en", "a"), (5, "", None, "b"),
        (6, " \n\t ", "fr", "c"), (7, "one two", "fr", "c"), (7, "one two", "fr", "c"), (None, "lonely words here", "fr", "a"), (None, None, None, None),
        (8, " ".join(words(8, 6000)), "en", "a"), (9, "word " * 300, "en", "b"), (10, "!!! 123", "de", "b"),
    ]
    rows = [(*r, 0, "x", 1.0, b"z", "y") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, sig int, node string, score double, set_key binary, hash string")


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)
