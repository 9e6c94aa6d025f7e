from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])


@pytest.fixture()
def docs_of(spark):
    """Documents from (doc_id, text[, source]) rows, with extra columns whose names clash with working ones."""

    def make(rows, **extra):
        full = [(*r, None)[:3] for r in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F

        for name in ("n", "x", "y", "level", "place", "score", "size", "w", "key", "doc", "line", "at", "h", "part", "pos"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture()
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
