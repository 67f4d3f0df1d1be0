import pytest


@pytest.fixture
def docs(spark):
    def make(*texts, **more):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
