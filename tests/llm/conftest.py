import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5), (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5), (2, "", "en", "a", 0), (3, None, None, None, None), (None, "no id here at all", "fr", "b", 1),
        (4, long, "en", None, 9), (5, long, "en", "b", 9), (6, " \t\n ", None, "b", 4), (7, "1234 --- 99", "de", "c", 3), (8, "ünï cödé ßß 漢字 😀", "fr", "c", 3), (9, "one", "en", "c", 3), (10, "alpha beta gamma delta epsilon", "en", "a", 5),
        (11, "a\nb\nc\nd", "en", "a", 5), (12, "a\nb\nc\nd", "en", "a", 5), (13, "x\nx\nx\nx\nx", "en", "a", 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("score", "rank", "size", "node", "id", "row", "held_out", "component_id", "sequence_id", "length", "h", "position", "n_removed", "lang_pred", "row", "words", "take", "key", "found",
              "__size", "__gone", "__k", "__x", "__lines", "__row", "__key", "__source", "__target", "__before", "__within", "__part", "__h", "__slope", "__w", "__rank", "__level", "__source_size", "__take"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
