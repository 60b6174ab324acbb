import pytest

KINDS = "doc_id long, text string, kept string, n_words int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, a shared doc_id, and columns whose names operators use."""
    long_text = " ".join(f"word{k % 977}" for k in range(30_000)) + "\n" + "x" * 20_000
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, "one two three", "c", 3), (3, "one two three", "c", 3), (4, long_text, "d", 4), (None, "no id at all here", "e", 5), (5, " \n\t ", None, None), (6, "é" * 60 + " 中文 😀 \x00 end", "f", 6), (7, "one two three", "g", 7)]
    return spark.createDataFrame(rows, KINDS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KINDS)
