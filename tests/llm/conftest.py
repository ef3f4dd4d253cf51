import pytest

LONG = "lorem ipsum dolor sit amet " * 4000
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of honey and thyme near an old stone bridge at dawn"


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, a null id, blanks, and columns with clashing names."""
    rows = [(1, None, "x", None), (2, "", None, 0), (3, LONG, "y", len(LONG)), (4, PROSE, "y", len(PROSE)), (4, PROSE, "y", len(PROSE)), (5, PROSE, None, 1), (None, PROSE, "z", None), (6, " \t\n ", "z", 4), (7, "one two three", "z", 13), (8, "ONE two\x0bthree", "z", 13), (9, "  日本 \U0001f600", "z", None)]
    return spark.createDataFrame([(*r, "shadow", 1.0, True) for r in rows], "doc_id long, text string, source string, n_chars long, host string, score double, kept boolean")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")
