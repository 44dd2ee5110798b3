"""Helpers shared by the operators: tables, row locators, scratch tables, words."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import configure, shared_path

# Arrow batches that a Python worker holds at once (rows and bytes, whichever is reached first).
ARROW_ROWS, ARROW_BYTES = "4096", str(8 << 20)
# ASCII white space, the separators of every word definition used here.
SPACE_CLASS = r"[\x20\x09-\x0D]"
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


_SHIPPED: set[str] = set()  # applications that have the package


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, as ``--py-files`` would: tasks unpickle functions by their module."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = tempfile.mkdtemp(prefix="tidemark-code-")  # on the driver, which serves the archive
    shutil.copytree(os.path.join(root, "tidemark"), os.path.join(copy, "src", "tidemark"),
                    ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(copy, "tidemark_code"), "zip", os.path.join(copy, "src")))
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: UTC, AQE, small Arrow batches; the package on the executors."""
    configure(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the cluster's shared folder."""
    return shared_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write ``df`` and read it back: cuts the lineage with a table all executors share."""
    spark = df.sparkSession
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that no later step reads."""
    jvm = spark._jvm
    for p in paths:
        if "/llm-" not in p:
            raise ValueError(f"not a scratch table: {p}")
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Plan nodes under which a scanned row keeps its place and stays one row.
_ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias"}


def is_scan(docs: DataFrame) -> bool:
    """True if ``docs`` is one file scan with nothing but deterministic projections and filters above it."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in _ROW_BY_ROW and node.deterministic():
        node = node.children().head()
    return node.nodeName() in ("LogicalRelation", "Relation") and node.children().isEmpty()


def scanned(docs: DataFrame, *columns: str, name: str = "docs") -> DataFrame:
    """``docs`` as a plain file scan: itself, or ``columns`` (all, if none) of it written to the shared folder.

    Rows of an exploded, joined, unioned, limited or generated frame have no place of their own in a file.
    """
    if is_scan(docs):
        return docs
    picked = docs.select(*[docs[f"`{c}`"] for c in columns]) if columns else docs
    return written(picked, scratch(docs.sparkSession, name))


def located(docs: DataFrame, *columns: str, name: str = "docs") -> DataFrame:
    """``columns`` of ``docs`` plus ``_file`` and ``_row``, the row's place in its Parquet file.

    The place is the same on every reading, so it identifies a row even where
    ids repeat or are null. A frame that isn't a plain file scan is written to
    the shared folder first.
    """
    docs = scanned(docs, *columns, name=name)
    meta = docs.metadataColumn("_metadata")
    return docs.select(*[docs[f"`{c}`"] for c in columns], meta["file_path"].alias("_file"), meta["row_index"].alias("_row"))


def utf8(column: pa.Array) -> list:
    """The UTF-8 bytes of a string column, one Python object per row (None for null)."""
    large = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def with_fields(schema: StructType, ddl: str) -> StructType:
    """``schema`` followed by the fields of a DDL string."""
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)


def normal_text(col):
    """Null as empty, every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), SPACE_CLASS + "+", " ")


def word_count(col):
    """Number of ``[^\\x20\\x09-\\x0D]+`` words; 0 for null."""
    squeezed = F.trim(normal_text(col))
    return F.when(squeezed == "", F.lit(0).cast("long")).otherwise(
        (F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long"))
