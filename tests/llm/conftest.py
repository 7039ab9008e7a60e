import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    return [f"w{r.randrange(10**6)}" for _ in range(4000)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids."""
    rows = [(1, "a b c", "en", "s1", 5), (1, "a b c", "en", "s1", 5), (1, "other text", None, "s2", None),
            (None, "a b c", "en", None, 1), (None, None, None, None, None), (2, "", "en", "s1", 0),
            (3, None, "en", "s2", 0), (4, "x " * 60_000, "en", "s1", 1), (5, " \n\t ", "de", "s3", 2),
            (6, "é ü 😀 ñ", "de", "s3", 2), (7, "y" * 300_000, "en", None, 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
