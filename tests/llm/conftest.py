import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, kind int, h long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents with extra columns whose names clash with inner ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, 2, 3) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars"))
