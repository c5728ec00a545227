import pytest

from traceaudit.llm.common import BATCHES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long"


@pytest.fixture(scope="session")
def corpus(spark):
    """A maker of documents with extra columns whose names clash with those of results."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)

    def make(rows):
        full = [(r + (None,) * 4)[:4] + (len(r[1] or ""), 0.5, 1) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
