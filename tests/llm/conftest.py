import uuid

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   StructField("lang", StringType()), StructField("source", StringType()),
                   StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def lspark(spark):
    from tidemark.llm.common import prepare
    return prepare(spark)


@pytest.fixture
def table_of(lspark, tmp_path):
    """Write rows as a Parquet table of several files and read it."""
    def make(rows, schema=DOCS, files=2):
        path = str(tmp_path / f"t-{uuid.uuid4().hex}")
        lspark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
        return lspark.read.parquet(path)
    return make


LONG = " ".join(f"word{i % 97}x{i}" for i in range(20_000))


@pytest.fixture
def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    body = " ".join(f"w{i}" for i in range(60))
    return [(1, body, "en", "a", 1), (2, body.replace(" ", "\t\n"), "en", "a", None), (2, body, "en", "b", 2),
            (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \t ", "en", None, 3), (None, body, "en", "b", 1),
            (None, None, "en", "b", 1), (6, LONG, "en", "b", 1), (7, LONG, "en", "c", 1), (8, "two words", "en", "c", 1),
            (8, "two words", "en", "c", 1), (9, body + " tail", "en", "c", 1), (10, "x", "en", "", 1)]


@pytest.fixture
def edge_docs(table_of, edge_rows):
    """The same with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    extra = ["_file", "_row", "uid", "digest", "size", "source_size", "features", "rank", "n", "label", "score", "body"]
    df = table_of(edge_rows)
    path = df.inputFiles()[0].rsplit("/", 1)[0] + "-extra"
    df.select("*", *[F.lit("clash").alias(c) for c in extra]).write.parquet(path)
    return df.sparkSession.read.parquet(path)
