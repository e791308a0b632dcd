"""Documents with the cases that every operator has to stand."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consectetur " * 12_000

ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \t\n ", "en", "a", 5), (4, "one two", "en", None, 7), (5, "one two", "en", None, 7),
    (5, "one two", "en", None, 7), (None, "no id here at all my friend", "fr", "b", 27), (None, None, None, "b", None), (6, LONG, "en", "b", len(LONG)),
    (7, "🙂 é ▁ \x00 ß", "de", "c", 9), (8, "mail a.b@c.org or 10.0.0.1 now", "en", "c", 30),
]


@pytest.fixture
def odd(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
