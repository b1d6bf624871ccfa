import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns."""
    long = "word " * 30_000 + "end"
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5),
        (3, None, None, None, None), (4, "", "en", "b", 0), (5, "  \n\t ", "de", None, 4), (6, "one two", "en", "a", 7),
        (7, long, "en", "a", len(long)), (8, "password = hunter2hunter2 x", "en", "c", 1), (None, "no id here at all", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F
    return df.withColumn("score", F.lit(1)).withColumn("n", F.lit("x")).withColumn("ids", F.lit("y")).withColumn("base", F.lit(2))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
