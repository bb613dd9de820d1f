import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, ids from 0; a tuple gives (doc_id, text, source)."""

    def make(items, extra=None):
        rows = []
        for i, x in enumerate(items):
            doc_id, text, source = x if isinstance(x, tuple) else (i, x, f"src{i % 3}")
            rows.append((doc_id, text, "en", source, len(text or "")) + ((extra,) if extra else ()))
        return spark.createDataFrame(rows, DOCS + (f", {extra} string" if extra else "")).repartition(2)

    return make
