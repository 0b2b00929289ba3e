import pytest

import __spark_entry__  # noqa: F401  registers the package for the Python workers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from texts or (id, text, source) rows."""

    def make(rows, extra=""):
        full = []
        for i, row in enumerate(rows):
            doc_id, text, source, *more = row if isinstance(row, tuple) else (i, row, "s")
            full.append((doc_id, text, "en", source, len(text or ""), *more))
        return spark.createDataFrame(full, SCHEMA + (", " + extra if extra else ""))

    return make


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
