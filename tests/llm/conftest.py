import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, piece string, fp string, rank int, length string, window int"
CLASH = (None, "a", 1, "x", 2)


def row(doc_id, text, lang=None, source=None):
    """A documents row with extra columns whose names the operators use inside."""
    return (doc_id, text, lang, source, None if text is None else len(text), *CLASH)


@pytest.fixture
def docs(spark):
    def make(pairs):
        return spark.createDataFrame([row(*p) for p in pairs], DOCUMENTS)
    return make
