"""Session construction and cluster-shared paths.

The library never invents machine-local paths on a cluster: lineage cuts and
job state go to the folder the cluster names in ``spark.checkpoint.dir``.
Only when that setting is absent *and* the master is local (tests, laptops)
do we fall back to a private temp folder.
"""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType

# Settings every job relies on; applied once per session (idempotent).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tidemark", conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume (UTC, AQE)."""
    for k, v in SESSION_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on an existing session: leave as is
            pass
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting it on the context if needed.

    Reads ``spark.checkpoint.dir`` from the session. Sets a private folder only
    when it is unset and the master is local (as in tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a folder shared by "
                "the cluster (e.g. on the distributed file system)")
        conf_dir = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", *parts) if "://" not in base else "/".join(
        [base.rstrip("/"), "tables", *parts])


def change_file_options(rows: DataFrame) -> dict[str, str]:
    """Parquet options of files of changes: their numbers and times seldom repeat, so a dictionary of them costs more
    than it saves; texts keep theirs."""
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, StringType)]
    return {"parquet.enable.dictionary": "false"} | {f"parquet.enable.dictionary#{c}": "true" for c in texts}


OPEN_FILES = 8  # of a task


@contextlib.contextmanager
def open_files(spark: SparkSession):
    """Within it, a task that writes to few folders keeps a file of each open; its rows are sorted by folder only where
    there are more than ``OPEN_FILES``."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(key, None)
    spark.conf.set(key, str(OPEN_FILES))
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
