import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, a string, h1 long, sig string, rep long, copy int"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text[, source]) as a documents table with extra columns whose names clash with inner ones."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", 1, "y", 2, 3) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
