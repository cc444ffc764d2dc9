import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, pos int, term string, k int"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from texts, with extra columns whose names the operators use inside."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "src0", None if t is None else len(t), 7, "x", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, SCHEMA)

    return make
