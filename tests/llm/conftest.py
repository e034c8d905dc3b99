import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("key", T.StringType()), T.StructField("n", T.LongType()), T.StructField("k", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("spans", T.StringType()),
])


@pytest.fixture
def make(spark):
    """Documents from (id, text[, source]) with extra columns whose names the operators use inside."""

    def build(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 7, 8, "y", "z", "z") for r in rows], DOCUMENT)

    return build
