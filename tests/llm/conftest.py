import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ties."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(6000))
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t", None, None, 3), (None, "one two three four", "en", "b", 18), (4, long, "en", "a", len(long)), (5, long, "en", "a", len(long)), (5, long, "en", "a", len(long)), (6, "é🙂 ü", "de", None, 4)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
