import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with nulls in every column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    long_text = " ".join(f"Word{i % 997} and{i}" for i in range(30_000))
    rows = [
        (0, "The cat sat on the mat and looked at the dog.\nA second line of it.", "en", "a", 10, 1.5, "x"),
        (1, None, "en", "a", None, None, None),
        (2, "", None, "b", 0, 2.0, "y"),
        (3, "   \n\t ", "en", None, 6, 3.0, "z"),
        (4, long_text, "en", "b", len(long_text), 4.0, "w"),
        (5, "The cat sat on the mat and looked at the dog.\nA second line of it.", "en", "a", 10, 1.5, "x"),
        (5, "The cat sat on the mat and looked at the dog.\nA second line of it.", "en", "a", 10, 1.5, "x"),
        (None, "no id here but some words of text", "de", "b", 5, 5.0, "v"),
        (None, None, None, None, None, None, None),
        (7, "12345 67890 !!", "de", "c", 14, 6.0, "u"),
        (8, "Der Hund sitzt auf der Matte und sieht die Katze an.", "de", "c", 52, 7.0, "t"),
    ]
    # score, size and key are names that operators use for columns of their own
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, size string").withColumn("key", F.lit(1))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
