import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("key", T.StringType()),
])

LINE = "one two three four five six seven eight nine ten"
ODD = [
    (1, LINE + "\nshort\n" + LINE, "en", "b", 10, "x", "k"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "x", "k"),
    (4, "  " + LINE + "\t\n", "en", "a", 5, "x", "k"),
    (5, "one  two", "en", "a", 5, "x", "k"),
    (6, "one two", "de", "a", 5, "x", "k"),
    (6, "one two", "de", "a", 5, "x", "k"),
    (None, "one two", "de", None, 5, "x", "k"),
    (8, "word " * 30_000, "en", "b", 150_000, "x", "k"),
    (9, LINE.replace("ten", "tenth") + " <|endoftext|> ñandú 你好 🙂", "fr", "c", 60, "x", "k"),
    (10, "\n\n \x0b\n", "fr", "c", 4, "x", "k"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, other columns whose names clash."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
