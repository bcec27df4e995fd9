import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, hit boolean, len int, full string"


@pytest.fixture
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, ties, and columns whose names operators use."""
    long_text = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (3, "one", "en", "a", 3), (4, "one two", None, "b", 7),
        (5, "one two three", "fr", "b", 9), (6, "one two three", "fr", None, 9), (6, "one two three", "fr", None, 9),
        (None, "one two three", None, "a", 1), (7, long_text, "en", "a", 1), (8, "x" * 50_000, "en", "a", 1),
        (9, " \t\n ", "en", "a", 1), (10, "12 34 !!", "en", "c", 1), (None, None, None, None, None),
        (11, "élan où ça ☃ \U0001f642", "fr", "c", 1), (12, long_text, "en", "b", 1), (13, "a\n\nb\na\nb\n", "en", "b", 1),
    ]
    return spark.createDataFrame([(*r, 5, True, 3, "f") for r in rows], SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
