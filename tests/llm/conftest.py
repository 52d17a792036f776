import pytest

LONG = "the quick brown fox jumps over the lazy dog and runs away from here "


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows and ids, ties, copies, a long text, extra columns with clashing names."""
    body = " ".join(f"word{i} stands here" for i in range(80))
    rows = [
        (1, body, "en", "s", None),
        (2, body, "en", "s", 3),
        (2, body, "en", "s", 3),
        (3, None, None, None, None),
        (4, "", "en", None, 0),
        (5, " \n\t ", "en", "s", 4),
        (6, "été ß 日本語 " * 30, "fr", "s", 9),
        (None, "a row without a name " * 8, "en", "s", 1),
        (7, LONG * 3, "en", "s", 1),
        (8, "start " + LONG + "end of it all", "en", "s", 1),
        (9, LONG * 900, "en", "s", 1),
        (10, "7 !!", "de", "s", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", F.lit(1).alias("kind"), F.lit("x").alias("id"), F.lit(2).alias("shard"), F.lit(3).alias("score"), F.lit(4).alias("fp"), F.lit(5).alias("tokens"), F.lit(6).alias("_b"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
