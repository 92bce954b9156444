import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"


@pytest.fixture
def docs(spark):
    """documents from (doc_id, text) or (doc_id, text, lang), with extra columns whose names clash with results."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, len(r[1] or ""), 0.5, None) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make
