import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, pii string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    rows = [(1, "the cat sat on the mat and slept all day", "en", "a", 40, 1.0, "x", "y"),
            (2, None, "en", "a", None, None, None, None), (3, "", None, None, 0, 1.0, "x", "y"),
            (4, " \n\t ", "en", "a", 4, 1.0, "x", "y"), (None, "no id here at all my friend", "en", "a", 5, 1.0, "x", "y"),
            (5, "12345 67890 !!", "en", "a", 14, 1.0, "x", "y"), (6, "wörter " * 30_000, "de", "b", 210_000, 1.0, "x", "y"),
            (7, "x" * 50_000, "de", "b", 50_000, 1.0, "x", "y")]
    rows += [(1, "the cat sat on the mat and slept all day", "en", "a", 40, 1.0, "x", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
