import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, text_hash string, _id string, blob string, spans string, word string, held_out boolean"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and extra columns with names that operators use."""
    long = " ".join(f"word{k % 997} x{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two three four five six"), (4, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"),
            (None, None), (6, long), (7, "single"), (8, "é" * 5000), (9, "a" * 200_000), (10, "ONE two Three four FIVE six"), (11, long + " tail")]
    return spark.createDataFrame([(i, t, *[None] * 11) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
