import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, size string, `group` int"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "delta", "über", "naïve", "x1", "zwei"]
    long = " ".join(rng.choice(words) for _ in range(4000))
    some = " ".join(rng.choice(words) for _ in range(60))
    rows = [
        (1, "", "en", "a", 0), (2, None, "en", "a", None), (3, " \t\n ", None, None, 3), (4, long, "de", "b", 9),
        (5, some, "en", "a", 1), (5, some, "en", "a", 1), (5, "other text here", "en", "c", 1), (None, some, "fr", "b", 1),
        (None, None, None, None, None), (6, some + " end", "en", None, 1), (7, long + " " + some, "de", "b", 2),
        (8, "12345 !!", "en", "a", 8), (9, some, None, "b", 5), (10, "one", "en", "a", 3), (11, "One", "en", "a", 3),
    ]
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
