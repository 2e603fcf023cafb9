import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts or (doc_id, text, lang, source); n_chars follows."""

    def make(*rows, schema=DOC):
        full = []
        for i, row in enumerate(rows):
            doc_id, text, lang, source = row if isinstance(row, tuple) else (i, row, "en", "a")
            full.append((doc_id, text, lang, source, len(text) if text is not None else None))
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def folder():
    """The small tables, which the whole queries are held against."""
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.exists(path):
        pytest.skip("test tables not present")
    return path
