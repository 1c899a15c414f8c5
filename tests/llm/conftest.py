import pytest

SCHEMA = "doc_id long, text string, ord string, block int, words string, hub long, bucket int, hash string, lang string, source string, n_chars long"


def documents(spark, rows, schema=SCHEMA):
    """A documents table with further columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "w", 2, 3, "h", "en", "s", len(t or "")) for i, t in rows], schema)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: documents(spark, rows)


LONG = " ".join(f"word{k % 977} and{k % 13}" for k in range(30_000))
EDGES = [(1, None), (2, ""), (3, "one two three"), (None, "a text without an id that is long enough to be of use here"), (5, LONG), (6, LONG), (7, "same row twice over\nb\nc\nd"), (7, "same row twice over\nb\nc\nd"), (8, "\n\n\n\n"), (9, "é ünï 日本語 🎉 " * 40)]


@pytest.fixture(scope="session")
def edges(spark):
    return documents(spark, EDGES)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
