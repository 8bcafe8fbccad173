import os

import pytest
from pyspark.sql import types as T

SF001 = "/root/testdata/sf0.001"

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text[, source]) rows with further columns whose names operators use inside."""
    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "1 AS piece", "'x' AS length", "0 AS size", "0 AS block", "'y' AS rank", "0 AS n",
                             "0 AS fingerprint", "0 AS key", "0 AS bucket", "0 AS score", "0 AS term") if extra else df
    return make


@pytest.fixture(scope="session")
def write_table(spark, tmp_path_factory):
    """Writes DataFrames as the tables of a folder that a query can read."""
    def write(**tables):
        folder = str(tmp_path_factory.mktemp("tables"))
        for name, df in tables.items():
            df.write.parquet(os.path.join(folder, f"{name}.parquet"))
        return folder
    return write
