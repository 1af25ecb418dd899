import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents of the texts given, ids from 0, with an extra column that clashes with inner names."""

    def make(texts, extra="key string"):
        rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, f"{DOCS}, {extra}")

    return make
