import pytest

#: A document that the quality rules keep.
GOOD = "The old harbour lies at the end of a long road, and it was built for boats that nobody has seen in years. People still come here in the summer to sit on the wall."


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names the operators might use."""
    rows = [
        (1, "alpha beta gamma delta epsilon", "x", 1), (1, "alpha beta gamma delta epsilon", "x", 1), (2, None, None, None), (3, "", "", 3), (None, "alpha beta gamma delta epsilon", "y", 4),
        (4, " \t\n", "z", 5), (5, "word " * 30000, "l", 6), (6, "é😀 " * 5 + "a@b.co\n" * 3, "u", 7), (7, "one", "o", 8),
        (8, GOOD, "g", 9),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, spans string, key bigint").selectExpr("*", "1 AS __q_text", "2 AS lid", "3 AS component_id", "4 AS quality")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
