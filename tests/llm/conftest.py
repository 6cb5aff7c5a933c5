import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with an extra column whose name clashes with inner ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, component string")

    return make
