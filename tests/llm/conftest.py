import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()),
                       T.StructField("key", T.StringType())])


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text[, lang[, source]]); ``row`` and ``key`` clash with inner names."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a",
                 None if r[1] is None else len(r[1]), "extra", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
