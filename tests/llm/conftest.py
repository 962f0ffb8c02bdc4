from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with an extra column whose name clashes."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOC).selectExpr("*", "'x' as label", "1 as size")

    return make


@pytest.fixture(scope="session")
def documents(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet").cache()
