import pytest

SCHEMA = "doc_id long, text string, lang string, shard int, score double, n_lines int, kinds string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns named like the operators' own."""
    base = " ".join(f"word{i % 97} item{i % 31}" for i in range(4000))
    rows = [(1, "a plain text of some words", "en"), (2, None, None), (3, "", "en"), (4, base, "en"), (5, "a plain text of some words", "fr"), (5, "a plain text of some words", "fr"), (6, "x", None), (7, "  spaced \n\n lines\t", "en")]
    rows = [(*r, 9, 0.5, 1, "k") for r in rows]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
