"""Sinks: several outputs from one micro-batch, keyed upserts into external
tables over JDBC, versioned full refresh, prefix refresh, and named standing
copy jobs.

All writers take ``(df, batch_id)`` so they run unchanged inside
``foreachBatch``; every write is idempotent per batch id (a retried batch
replaces its own output).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Writer = Callable[[DataFrame, int], None]


def _join(path: str, *parts: str) -> str:
    return "/".join([path.rstrip("/"), *parts]) if "://" in path else os.path.join(path, *parts)


# ------------------------------------------------------------------ statement set

def multi_sink(batch: DataFrame, batch_id: int, writers: Sequence[Writer]) -> None:
    """Write one micro-batch to several sinks as one unit: the batch is
    persisted once (each sink re-reads memory, not the source), then each
    writer runs with the same batch id."""
    batch = batch.persist()
    try:
        for w in writers:
            w(batch, batch_id)
    finally:
        batch.unpersist()


def parquet_sink(path: str, transform: Callable[[DataFrame], DataFrame] | None = None,
                 partition_cols: Sequence[str] = ()) -> Writer:
    """Writer appending ``transform(batch)`` under ``batch_id=<n>`` (dynamic
    partition overwrite: a retried batch replaces only its own partition)."""
    def write(df: DataFrame, batch_id: int) -> None:
        out = transform(df) if transform else df
        out = out.withColumn("batch_id", F.lit(int(batch_id)).cast("bigint"))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id", *partition_cols).parquet(path))
    return write


# ------------------------------------------------------------------------- JDBC

def upsert_statement(dialect: str, table: str, staging: str, keys: Sequence[str],
                     cols: Sequence[str]) -> str:
    """SQL that merges ``staging`` into ``table`` by ``keys`` on the database side.

    ``postgres``: INSERT … ON CONFLICT (keys) DO UPDATE; ``mysql``: INSERT …
    ON DUPLICATE KEY UPDATE; ``ansi``: MERGE INTO."""
    non_keys = [c for c in cols if c not in keys]
    collist = ", ".join(cols)
    if dialect == "postgres":
        sets = ", ".join(f"{c} = EXCLUDED.{c}" for c in non_keys)
        action = f"DO UPDATE SET {sets}" if non_keys else "DO NOTHING"
        return (f"INSERT INTO {table} ({collist}) SELECT {collist} FROM {staging} "
                f"ON CONFLICT ({', '.join(keys)}) {action}")
    if dialect == "mysql":
        sets = ", ".join(f"{c} = VALUES({c})" for c in non_keys) or f"{keys[0]} = {keys[0]}"
        return f"INSERT INTO {table} ({collist}) SELECT {collist} FROM {staging} ON DUPLICATE KEY UPDATE {sets}"
    if dialect == "ansi":
        on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
        sets = ", ".join(f"{c} = s.{c}" for c in non_keys)
        vals = ", ".join(f"s.{c}" for c in cols)
        upd = f"WHEN MATCHED THEN UPDATE SET {sets} " if non_keys else ""
        return (f"MERGE INTO {table} t USING {staging} s ON ({on}) {upd}"
                f"WHEN NOT MATCHED THEN INSERT ({collist}) VALUES ({vals})")
    raise ValueError(dialect)


def insert_ignore_statement(table: str, staging: str, keys: Sequence[str], cols: Sequence[str]) -> str:
    """ON CONFLICT DO NOTHING, written portably as an anti join."""
    collist = ", ".join(cols)
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    return (f"INSERT INTO {table} ({collist}) SELECT {', '.join('s.' + c for c in cols)} FROM {staging} s "
            f"WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {on})")


def jdbc_upsert_sink(url: str, table: str, keys: Sequence[str], properties: dict[str, str],
                     dialect: str = "postgres", batchsize: int = 100, num_partitions: int = 8,
                     retries: int = 3) -> Writer:
    """Writer: keyed upsert of each micro-batch into an external table.

    The batch is written in parallel (``num_partitions`` connections,
    ``batchsize`` rows per round trip — the reference's flush size) to a staging
    table named after the batch id, then merged by key in one statement on the
    database side and the staging table dropped. A retried batch rewrites its
    staging table, so the merge is idempotent. The merge statement is retried
    up to ``retries`` times."""
    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        staging = f"{table}_stg_{int(batch_id)}"
        (df.repartition(num_partitions).write.mode("overwrite")
         .option("batchsize", batchsize).jdbc(url, staging, properties=properties))
        stmt = upsert_statement(dialect, table, staging, keys, df.columns)
        _execute(spark, url, properties, [stmt, f"DROP TABLE {staging}"], retries)
    return write


def _execute(spark: SparkSession, url: str, properties: dict[str, str], statements: Sequence[str],
             retries: int) -> None:
    jvm = spark._jvm
    props = jvm.java.util.Properties()
    for k, v in properties.items():
        props.setProperty(k, v)
    last = None
    for _ in range(max(1, retries)):
        conn = None
        try:
            conn = jvm.java.sql.DriverManager.getConnection(url, props)
            conn.setAutoCommit(False)
            st = conn.createStatement()
            for s in statements:
                st.executeUpdate(s)
            conn.commit()
            return
        except Exception as e:  # noqa: BLE001 - retry then re-raise
            last = e
            if conn is not None:
                try:
                    conn.rollback()
                except Exception:  # noqa: BLE001
                    pass
        finally:
            if conn is not None:
                conn.close()
    raise last


def cross_db_read(spark: SparkSession, url: str, query: str, properties: dict[str, str],
                  partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                  num_partitions: int = 8) -> DataFrame:
    """Read a remote query through JDBC (the database runs the pushed query);
    with a numeric partition column the read is split into parallel ranges."""
    r = spark.read.format("jdbc").option("url", url)
    for k, v in properties.items():
        r = r.option(k, v)
    if partition_column is not None:
        r = (r.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
             .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", num_partitions))
    else:
        r = r.option("query", query)
    return r.load()


# ---------------------------------------------------------------- refresh styles

def full_refresh(df: DataFrame, base: str, version: int) -> str:
    """Replace a result table: write version ``v`` completely, readers switch
    to the newest complete version (no partial visibility; re-running a
    version rewrites it)."""
    out = _join(base, f"version={int(version)}")
    df.write.mode("overwrite").parquet(out)
    return out


def read_latest(spark: SparkSession, base: str) -> DataFrame:
    """Newest complete version written by ``full_refresh`` (has _SUCCESS)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            versions.append(int(name.split("=", 1)[1]))
    if not versions:
        raise FileNotFoundError(base)
    return spark.read.parquet(_join(base, f"version={max(versions)}"))


def prefix_refresh(existing: DataFrame, fresh: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """Delete rows whose id starts with ``prefix`` (a literal prefix — the
    reference's LIKE 'SYNC_%' also matched any character at the '_'), then add
    the fresh rows."""
    return existing.where(~F.col(id_col).startswith(prefix)).unionByName(fresh)


def continuous_sync(stream: DataFrame, name: str, writer: Writer, checkpoint: str,
                    processing_time: str | None = "60 seconds", available_now: bool = False):
    """A named standing copy job (one per layer), restartable from its checkpoint."""
    w = stream.writeStream.queryName(name).foreachBatch(writer).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
