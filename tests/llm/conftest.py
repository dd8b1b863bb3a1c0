from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, f0 double"
LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use for results."""

    def make(rows, lang="en"):
        return spark.createDataFrame([(i, t, lang, "src", None if t is None else len(t), 9.0, "x", 1.0) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame([(i, q, t, "other") for i, q, t in rows], LABELS)

    return make


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "no id"), (5, "same"), (5, "same"), (6, "é😀ß " * 30_000), (7, "a" * 100_000), (8, "\n" * 5_000)]
