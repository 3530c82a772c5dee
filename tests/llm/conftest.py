import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source) tuples."""
    def build(items, schema="doc_id long, text string, lang string, source string, n_chars long"):
        full = [(i[0], i[1], i[2] if len(i) > 2 else "en", i[3] if len(i) > 3 else "s",
                 len(i[1]) if i[1] is not None else None) for i in items]
        return spark.createDataFrame(full, schema)
    return build
