"""Documents of odd rows; the other fixtures come from the folder above."""

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, ids string, key int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with clashing extra columns."""

    def make(rows):
        full = [(i, t, "en", (rest[0] if rest else "s"), len(t or ""), 0.5, "x", 1) for i, t, *rest in rows]
        return spark.createDataFrame(full, DOCS)

    return make
