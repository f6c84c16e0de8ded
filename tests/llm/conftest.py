import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows."""
    def make(rows, partitions=3):
        full = [(*r, *(["en", "a"][len(r) - 2:] if len(r) < 4 else []), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def vocab():
    from cupboard.llm.queries import vocabulary

    return vocabulary()
