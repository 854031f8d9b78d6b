import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use themselves."""
    def make(rows, **more):
        rows = [(i, t, "en", "src0", None if t is None else len(t), "x", 7) for i, t in rows]
        return spark.createDataFrame(rows, DOCUMENTS + ", k1 string, n_words int")
    return make


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
