import pytest

LONG = ("word " * 3000 + "x" * 5000 + " tail. ") * 2


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows and ids."""
    plain = "The quick brown fox jumps over the lazy dog. It's 12 o'clock, Straße déjà-vu! "
    rows = [(1, plain * 8), (2, plain * 8), (3, None), (4, ""), (None, "no id at all"), (5, LONG), (6, " \n\t "), (7, plain * 7 + "Another end."), (7, "second text of seven"), (8, "中文 🙂\x1c\x01 naïve <|endoftext|>")]
    return [*rows, rows[0]]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with extra columns whose names clash with those inside the operators."""
    rows = [(i, t, "en", "src1" if k % 2 else None, k, "x", 1, "y", True) for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, n_tokens int, spans string, kept boolean")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
