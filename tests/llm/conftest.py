import pytest

EDGE = [
    (1, "", "en", "s", 0),
    (2, None, None, None, None),
    (3, " \t\n", "en", "s", 3),
    (4, "one", "en", "s", 3),
    (None, "a doc without an id but with some words in it", "en", "s", 45),
    (6, "same text as the next row has and more", "en", "t", 10),
    (6, "same text as the next row has and more", "en", "t", 10),
    (7, "w" * 50_000 + " " + "long text " * 30_000, "en", "t", 1),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, blanks, one word, repeated rows, a very long text, and columns that clash with added names."""
    docs = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return docs.selectExpr("*", "'x' AS slot", "'y' AS n", "'z' AS Found", "'k' AS component", "1 AS n_pii").withColumn("key", F.lit("q"))


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("1 = 0")
