import pytest

TEXTS = ["a b c d e f", "A b c\td e f", "", None, "   ", "é" * 300, "word " * 5000, "a b c d e f"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, and columns with clashing names."""
    rows = [(k if k != 2 else None, t, "en" if k % 2 else None, "s" if k % 3 else None, 1, k, "x", 0.5) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string, n_chars long, _size int, fp string, score double")
