"""Standing jobs built from the operators: ODS ingest of a change stream into
a PK table, and the hot/cold tier cycle with its commit order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import tier as H
from tidemark.streaming.pktable import PKTable


def ingest_stream(stream: DataFrame, table: PKTable, checkpoint: str, available_now: bool = True,
                  processing_time: str = "30 seconds", name: str | None = None):
    """Change stream → PK table, one log batch per micro-batch (the Spark batch
    id is the table version, so a replayed micro-batch overwrites itself)."""
    w = stream.writeStream.foreachBatch(lambda df, bid: table.write_batch(df, bid)) \
        .option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


class TierMismatch(RuntimeError):
    pass


def _path_exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _same_rows(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether both hold the same number of rows and the same keys."""
    return (a.count() == b.count() and a.join(b.select(key), key, "left_anti").isEmpty()
            and b.join(a.select(key), key, "left_anti").isEmpty())


def tier_cycle(hot: PKTable, cold_path: str, as_of: dt.datetime, version: int, hot_days: int = 7,
               key: str = "ticket_id") -> dict:
    """One archive cycle of the hot ticket table.

    1. stage: the full new content of every archive date touched, rows already
       archived and rows that leave the hot tier, is written beside the cold
       table and committed; of one ticket the hot row counts;
    2. verify: the staged keys are the old ones of those dates and the expiring
       ones, none missing, none twice; otherwise stop before changing anything;
    3. switch: the touched dates of the cold table are replaced from the stage
       and compared with it. A cycle that died here left its stage behind: the
       next cycle replays it first;
    4. expire: delete markers for the archived keys go to the hot table's log
       as batch ``version`` of a writer of their own (seq one above the row's,
       so the delete wins and no ingest batch is overwritten).
    """
    spark = hot.spark
    stage = cold_path.rstrip("/") + "-stage"
    if _path_exists(spark, f"{stage}/_SUCCESS"):
        H.write_cold(spark.read.parquet(stage), cold_path)
    state = hot.read()
    fresh = H.archive_cold(state, as_of, hot_days).persist()
    try:
        expiring = fresh.count()
        if expiring == 0:
            return {"archived": 0, "expired": 0}
        old = spark.read.parquet(cold_path).select(*fresh.columns) if _path_exists(spark, cold_path) else None
        merged = H.merge_cold(old, fresh, key)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(stage)
        staged = spark.read.schema(merged.schema).parquet(stage)
        wanted = fresh.select(key)
        if old is not None:
            wanted = wanted.unionByName(old.join(fresh.select("archive_date").distinct(), "archive_date", "left_semi")
                                        .select(key)).distinct()
        if not _same_rows(staged, wanted, key):
            raise TierMismatch("the staged archive dates do not hold the old and the expiring rows")
        H.write_cold(staged, cold_path)
        now = spark.read.parquet(cold_path).join(fresh.select("archive_date").distinct(), "archive_date", "left_semi")
        if not _same_rows(now, staged, key):
            raise TierMismatch("the archived dates differ from their stage")
        dels = state.join(fresh.select(key), key, "left_semi").select(
            F.lit("d").alias("op"), (F.col("seq") + 1).alias("seq"), key)
        hot.write_batch(dels, version, writer="expire")
        p = spark._jvm.org.apache.hadoop.fs.Path(stage)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        return {"archived": expiring, "expired": expiring}
    finally:
        fresh.unpersist()


def refresh_on_change(stream: DataFrame, table: PKTable, compute, writer, checkpoint: str,
                      available_now: bool = True, processing_time: str = "30 seconds"):
    """Live metric table: each micro-batch is applied to the PK table, then
    ``compute(state)`` — any batch function, unchanged — is evaluated on the
    table as of that batch and handed to ``writer(result, batch_id)``.

    Suited to small results over the state (global metrics, per-day
    counters); keyed results over large states use affected-key recompute
    (``streaming.incremental``)."""
    def step(df: DataFrame, batch_id: int) -> None:
        table.write_batch(df, batch_id)
        writer(compute(table.as_of(batch_id)), batch_id)

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
