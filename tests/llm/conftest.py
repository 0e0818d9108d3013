import pytest


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) pairs, or with further columns."""

    def build(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return build
