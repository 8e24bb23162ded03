import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

GIVEN = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, `n_words` string, size string"


@pytest.fixture(scope="session")
def given():
    if not os.path.isdir(GIVEN):
        pytest.skip("no given tables here")
    return GIVEN


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    passage = " ".join(f"word{i}" for i in range(120))
    rows = [
        (1, passage, "en", "a", 5, "x", "y", "z"),
        (2, passage + " and more", "en", "a", 5, None, "y", "z"),
        (2, passage + " and more", "en", "a", 5, None, "y", "z"),
        (2, "another text under the same id", "en", None, 5, None, None, None),
        (None, passage, None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None),
        (7, "", "en", "b", 0, "x", "y", "z"),
        (8, " \t\n\r\x0b\x0c ", "en", "b", 0, "x", "y", "z"),
        (9, "a\nb\nc\na\nb\nc\na\nb\nc", "fr", "b", 0, "x", "y", "z"),
        (10, "1234 5678 %%%", "fr", "c", 0, "x", "y", "z"),
        (2**60 + 1, "é" * 5000 + " " + "ab " * 20000, "fr", "c", 0, "x", "y", "z"),
        (2**60 + 2, "é" * 5000 + " " + "ab " * 20000, "fr", "c", 0, "x", "y", "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
