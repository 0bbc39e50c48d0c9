from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: names that operators give to columns of their own
CLASHING = ["size", "h", "kept", "n_words", "component_id", "copies", "n_removed", "_words", "_doc", "_s", "fp", "score", "words"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"word{i % 977} and" for i in range(60_000)) + "\n" + "x" * 200_000
    para = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion and the old clock strikes noon in the market square again"
    rows = [
        (1, para, "en", "a", 3),
        (1, para, "en", "a", 3),
        (2, para + "\n" + para, "en", "b", 3),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (None, para + " more", "de", "b", 1),
        (None, None, None, None, None),
        (5, long, "fr", None, 9),
        (6, " \t\n\r\n ", "fr", "c", 9),
        (7, "!!! ### $$$ 1234 é中\U0001f600 ▁x <|endoftext|>", "es", "c", 9),
        (8, "\n".join(f"line {i % 3}" for i in range(50)), "es", "c", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("extra") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
