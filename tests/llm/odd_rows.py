import pytest
from pyspark.sql import functions as F

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing column names."""
    rows = [
        (1, "alpha beta gamma delta " * 20, "en", "a", 1), (2, "alpha  beta gamma delta\n" * 20, "en", "a", 1),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \t\n ", "de", "b", 4), (6, LONG, "en", "b", len(LONG)),
        (7, "same row", "fr", "c", 8), (7, "same row", "fr", "c", 8), (None, "no id at all here", "fr", "c", 8),
        (None, None, None, None, None), (8, "1234 5678 !!", "es", None, 12), (9, "été où ñandú 漢字 \U0001f642 x", "fr", "é", 20),
        (10, "One two three", "en", "", 13), (11, "one two three", "en", "", 13), (12, "a\rb\x0bc\x0cd", "en", "a", 7),
    ]
    docs = spark.createDataFrame(rows, ODD_SCHEMA)
    for clash in ("row", "key", "keep_id", "kept", "size", "start", "norm", "hot", "words", "lines", "fingerprint",
                  "component_id", "sequence_id", "offset", "length", "number", "taken", "target", "score"):
        docs = docs.withColumn(clash, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
