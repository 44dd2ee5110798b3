"""Standing batch jobs on live tables, by mergeable partial aggregates.

A job is two functions: ``partial`` reduces the rows of a bucket of the table to
one row, ``merge`` makes the result of the bucket rows. A micro-batch is applied
to the table, the partials of the buckets it touches are computed again, and the
result is merged from one row a bucket: what a batch reads follows the buckets it
touches, not the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.streaming.pktable import PKTable


class LiveJob:
    """``partial``: name -> aggregate expression over the rows of a bucket; ``merge(partials) -> result`` over the
    frame of bucket rows (bucket and the names). The partials live in a PK table of one row a bucket."""

    def __init__(self, spark: SparkSession, table: PKTable, path: str, partial: dict[str, Column],
                 merge: Callable[[DataFrame], DataFrame]):
        self.table, self.partial, self.merge = table, partial, merge
        self.partials = PKTable(spark, path, ["part"], 1)

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            self.table.write_batch(batch, batch_id)
            keys = batch.select(*self.table.bucket_keys)
            part = self.table.bucket_col().alias("part")
            touched = keys.select(part).distinct()
            state = self.table.latest_in(batch_id, keys)
            now = state.groupBy(self.table.bucket_col().alias("part")).agg(*[e.alias(c) for c, e in self.partial.items()])
            # a bucket whose rows are all gone has no partial any more
            rows = touched.join(now.withColumn("op", F.lit("u")), "part", "left").withColumn(
                "op", F.coalesce("op", F.lit("d"))).withColumn("seq", F.lit(int(batch_id)).cast("bigint"))
            self.partials.write_batch(rows, batch_id)
        finally:
            batch.unpersist()

    def run(self, stream: DataFrame, checkpoint: str, writer: Callable[[DataFrame, int], None] | None = None) -> None:
        """Process what is there (availableNow); ``writer(result, batch_id)`` gets the result of every batch."""
        def step(batch: DataFrame, batch_id: int) -> None:
            self.process_batch(batch, int(batch_id))
            if writer is not None:
                writer(self.result(), int(batch_id))
        (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())

    def result(self) -> DataFrame:
        return self.merge(self.partials.read())


TICKET_COLS = ["op", "seq", "ticket_id", "status", "created_at", "closed_at"]


def ticket_metrics_job(spark: SparkSession, root: str, buckets: int = 16) -> LiveJob:
    """``tickets.ticket_metrics`` (but the run time) as a standing job on the live ticket table."""
    status = F.col("status")
    minutes = R.minutes_between("created_at", "closed_at")
    states = ["pending", "in_progress", "resolved", "closed"]
    partial = {"n": F.count(F.lit(1)), **{s: F.count(F.when(status == s, 1)) for s in states},
               "minutes": F.sum(minutes), "n_minutes": F.count(minutes)}

    def merge(p: DataFrame) -> DataFrame:
        def total(c):
            return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
        return p.agg(total("n").alias("total_tickets"), *[total(s).alias(f"{s}_tickets") for s in states],
                     F.try_divide(F.sum("minutes").cast("double"), F.sum("n_minutes")).alias("avg_resolution_time_minutes"))
    table = PKTable(spark, f"{root}/tickets", ["ticket_id"], buckets)
    return LiveJob(spark, table, f"{root}/partials", partial, merge)
