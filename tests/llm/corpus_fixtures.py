import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def corpus(spark):
    """Documents from texts, with ids from 0; other columns are NULL."""

    def make(*texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts)], SCHEMA)

    return make


@pytest.fixture
def labels(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
