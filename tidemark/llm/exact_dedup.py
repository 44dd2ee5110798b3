"""Exact deduplication as a stateful stream.

Documents are logged as narrow rows: stable id, content locator (Parquet file
and row index) and digest of the normalised text. A Structured Streaming
aggregation over that log keeps one state entry per digest, on disk (RocksDB)
and without expiry: the id and locator of the row that stays and the size of
the group. Spark combines rows of one digest before the shuffle, so a digest
with a third of all rows sends one row per task. State, offsets and results
live under one folder, so a restart or a later call with more documents goes
on where the last one ended.

A digest hit alone proves nothing: the whole normalised text of every row in
a group is then fetched by its locator and compared, byte for byte, with the
text of the row that stays. Groups where a comparison fails (a digest
collision) are regrouped on the full text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import is_scan, located, normal_text, scanned, scratch, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # no preallocation: a manifest takes 4 MB for each of the many small stores otherwise
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
LOG = "doc_id long, _file string, _row long, digest string, text_sha256 string"
KEEP = "keep struct<none:boolean,id:long,file:string,row:long>"


def _sha(norm: Column) -> Column:
    return F.sha2(norm, 256)


class ExactDedup:
    """Deduplication state in ``root`` (a folder all executors share).

    ``digest`` maps the normalised text to the state key; tests pass a short
    one to provoke collisions. ``batch_bytes`` bounds a micro-batch.
    """

    def __init__(self, spark: SparkSession, root: str, digest: Callable[[Column], Column] = _sha,
                 batch_bytes: int = 4 << 30):
        self.spark, self.root, self.digest, self.batch_bytes = spark, root, digest, batch_bytes

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Log ``docs`` (rows of Parquet files that stay in place) and bring the state up to date."""
        self._in_files(docs)
        src = located(docs, id_col, text_col).toDF("doc_id", "text", "_file", "_row")
        norm = normal_text(F.col("text"))
        log = src.select(F.col("doc_id").cast("long").alias("doc_id"), "_file", "_row",
                         self.digest(norm).alias("digest"), _sha(norm).alias("text_sha256"))
        log.write.mode("append").parquet(f"{self.root}/log")
        self.update()

    @staticmethod
    def _in_files(*docs: DataFrame) -> None:
        if not all(is_scan(d) for d in docs):
            raise ValueError("the state points into files: write the frame and read it back first")

    def update(self) -> None:
        """Run micro-batches until every logged row is in the state."""
        spark = self.spark
        before = {k: spark.conf.get(k, None) for k in STATE_CONF}
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        try:
            stream = (spark.readStream.schema(LOG).option("maxBytesPerTrigger", self.batch_bytes)
                      .parquet(f"{self.root}/log"))
            mine = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                            F.col("_file").alias("file"), F.col("_row").alias("row"))
            state = stream.groupBy("digest").agg(F.min(mine).alias("keep"), F.count("*").alias("group_size"))
            out = f"{self.root}/state"

            def land(batch: DataFrame, no: int) -> None:  # a repeated batch overwrites itself
                batch.write.mode("overwrite").parquet(f"{out}/batch_no={no}")

            (state.writeStream.outputMode("update").option("checkpointLocation", f"{self.root}/checkpoint")
             .trigger(availableNow=True).foreachBatch(land).start().awaitTermination())
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.root}/log")

    def state(self) -> DataFrame:
        """digest, keep (none, id, file, row), group_size: the newest entry of each digest.

        A group only grows, so its newest entry is its largest.
        """
        seen = (self.spark.read.schema(f"digest string, {KEEP}, group_size long, batch_no long")
                .option("basePath", f"{self.root}/state").parquet(f"{self.root}/state"))
        return seen.groupBy("digest").agg(
            F.max(F.struct("group_size", "keep")).alias("top")).select("digest", "top.keep", "top.group_size")

    def collisions(self, docs: list[DataFrame], state: DataFrame, text_col: str = "text") -> DataFrame:
        """Digests of groups in which some row's full text differs from that of the row that stays.

        Both joins end in a write, so an executor's share of a digest with very many rows is split where it is large.
        """
        groups = state.where("group_size > 1").select(
            "digest", F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"))
        every = self._texts(docs, None, text_col).select("norm", "digest", "_file", "_row")
        hits = written(every.join(groups.hint("merge"), "digest"), scratch(self.spark, "dedup-hits"))
        stays = hits.where("_file = keep_file and _row = keep_row").select("digest", F.col("norm").alias("kept_norm"))
        differ = hits.select("digest", "norm").join(stays.hint("merge"), "digest").where("norm <> kept_norm")
        return written(differ.select("digest"), scratch(self.spark, "dedup-differ")).distinct()

    def _texts(self, docs: list[DataFrame], id_col: str | None, text_col: str) -> DataFrame:
        """doc_id, norm, digest, _file, _row of the rows of all frames."""
        out = None
        for d in docs:
            d = located(d, id_col, text_col).toDF("doc_id", "text", "_file", "_row") if id_col else \
                located(d, text_col).toDF("text", "_file", "_row").withColumn("doc_id", F.lit(None))
            norm = normal_text(F.col("text"))
            d = d.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"),
                         self.digest(norm).alias("digest"), "_file", "_row")
            out = d if out is None else out.unionByName(d)
        return out

    def decisions(self, *docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per logged row: doc_id, _file, _row, keep_id, group_size, kept, text_sha256.

        ``docs``: the frames that were ingested.
        """
        self._in_files(*docs)
        cols = ["doc_id", "_file", "_row", "keep_id", "group_size", "kept", "text_sha256"]
        state = written(self.state(), scratch(self.spark, "dedup-state"))
        bad = written(self.collisions(list(docs), state, text_col), scratch(self.spark, "dedup-collisions"))
        rows = self.log().join(state, "digest")
        stays = (F.col("_file") == F.col("keep.file")) & (F.col("_row") == F.col("keep.row"))
        result = rows.withColumn("keep_id", F.col("keep.id")).withColumn("kept", stays)
        if bad.isEmpty():
            return result.select(cols)
        # regroup colliding digests on the full text
        mixed = self._texts(list(docs), id_col, text_col).join(bad, "digest", "left_semi")
        mine = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                        F.col("_file").alias("file"), F.col("_row").alias("row"))
        exact = mixed.groupBy("norm").agg(F.min(mine).alias("keep"), F.count("*").alias("group_size"))
        fixed = mixed.join(exact, "norm").withColumn("keep_id", F.col("keep.id")).withColumn(
            "kept", stays).withColumn("text_sha256", _sha(F.col("norm")))
        return result.join(bad, "digest", "left_anti").select(cols).unionByName(fixed.select(cols))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate ``docs`` alone, with a state of its own; columns as ``ExactDedup.decisions``.

    Null text counts as empty. Null ids count as largest. Of rows that repeat
    both id and text, the one that comes first in the files stays. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    docs = scanned(docs, id_col, text_col)
    job = ExactDedup(spark, scratch(spark, "exact-dedup"))
    job.ingest(docs, id_col, text_col)
    return job.decisions(docs, id_col=id_col, text_col=text_col)


