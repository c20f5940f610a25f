import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, ids string, spans string, h long, `size` long, s string, fp long, node long, _row int, _draw int, _runs string, _score double, __order int, __row int, _text string, n_words long, `row` long, c0 int, held_out string, n long, _metadata string"
LONG = "Lorem ipsum dolor " * 6000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, ties, and extra columns whose names clash with those in use inside."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "b", 43),
        (1, "the quick brown fox jumps over the lazy dog", "en", "b", 43),
        (2, "The Quick brown fox jumps over the lazy dog", "en", "a", 43),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n ", "en", None, 4),
        (6, LONG, "en", "a", len(LONG)),
        (7, "naïve café – 漢字 🙂 aaaaa\u0000b ababab ıſ K", "fr", "é", 30),
        (None, "one two", None, "b", 7),
        (8, "password = hunter2secret; key AKIA" + "A1B2C3D4E5F6G7H8" + " " + "0123456789abcdef01234567", "en", "b", 80),
    ]
    return spark.createDataFrame([(*r, "x", "y", 1, 2, "z", 3, 4, -7, -8, "r", 0.25, -9, -10, "t", 99, 77, 5, "no", 6, "m") for r in rows], ODD)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD)
