import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, row string"


@pytest.fixture
def docs_of(spark):
    """A documents table of (id, text) pairs, with extra columns whose names clash."""

    def build(rows):
        return spark.createDataFrame([(i, t, None, "s", 0, "x", "y") for i, t in rows], DOCS)

    return build
