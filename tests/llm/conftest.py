import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts (ids 0, 1, ...) or (id, text) pairs."""

    def make(*rows):
        pairs = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], DOCS)

    return make


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
