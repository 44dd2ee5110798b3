"""Throughput and latency of running streaming jobs, measured by the jobs themselves.

``observed`` adds metrics to a stream that Spark computes while it runs each
micro-batch (``Dataset.observe``): rows, rows without an event time, the oldest
and newest event time. ``JobMonitor`` is a query listener that records one row
for each micro-batch with them: no extra pass over the data.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "job_monitor"
SCHEMA = ("query string, batch_id long, rows long, rows_without_time long, oldest_event timestamp, newest_event timestamp, "
          "started timestamp, batch_ms long, rows_per_second double, delay_seconds double")


def observed(stream: DataFrame, event_time: str) -> DataFrame:
    """``stream`` with the metrics of its micro-batches."""
    t = F.unix_micros(F.to_timestamp(F.col(event_time)))
    return stream.observe(METRICS, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(event_time).isNull(), 1)).alias("untimed"),
                          F.min(t).alias("oldest"), F.max(t).alias("newest"))


def _row(progress, name: str) -> tuple | None:
    """What one micro-batch's progress says; None for a stream without the metrics."""
    import datetime as dt
    m = progress.observedMetrics.get(METRICS)
    if m is None:
        return None

    def at(us):
        return None if us is None else dt.datetime.fromtimestamp(us / 1e6, dt.timezone.utc).replace(tzinfo=None)
    started = dt.datetime.strptime(progress.timestamp, "%Y-%m-%dT%H:%M:%S.%fZ")
    ms, newest = int(progress.batchDuration), at(m["newest"])
    done = started + dt.timedelta(milliseconds=ms)
    return (name, int(progress.batchId), int(m["rows"]), int(m["untimed"]), at(m["oldest"]), newest, started, ms,
            m["rows"] * 1000 / ms if ms else None, None if newest is None else (done - newest).total_seconds())


def batches_of(spark: SparkSession, query, name: str) -> DataFrame:
    """One row for each of the last micro-batches of ``query`` that Spark remembers (100, unless set otherwise)."""
    rows = [_row(p, name) for p in query.recentProgress]
    return spark.createDataFrame([r for r in rows if r is not None and r[2]], SCHEMA)


class JobMonitor(StreamingQueryListener):
    """Records the micro-batches of queries over ``observed`` streams. ``keep``: batches held in memory, the newest;
    ``flush`` writes them as a table, so a long-running job holds a bounded number."""

    def __init__(self, keep: int = 10_000):
        self.keep, self.rows, self._lock = keep, [], threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = _row(event.progress, event.progress.name or str(event.progress.id))
        if row is not None:
            with self._lock:
                self.rows = [*self.rows[1 - self.keep:], row]

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each recorded micro-batch."""
        with self._lock:
            return spark.createDataFrame(list(self.rows), SCHEMA)

    def flush(self, spark: SparkSession, path: str) -> None:
        """Append the recorded rows to the table at ``path`` and forget them."""
        with self._lock:
            rows, self.rows = self.rows, []
        if rows:
            spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(path)


def throughput(monitor: DataFrame) -> DataFrame:
    """Per query and minute: rows, seconds spent, rows a second, the largest delay of the newest event of a batch."""
    return monitor.groupBy("query", F.date_trunc("minute", "started").alias("time_minute")).agg(
        F.sum("rows").alias("records_per_minute"), (F.sum("batch_ms") / 1000).alias("busy_seconds"),
        F.try_divide(F.sum("rows") * 1000.0, F.sum("batch_ms")).alias("rows_per_second"), F.max("delay_seconds").alias("max_delay_seconds"))
