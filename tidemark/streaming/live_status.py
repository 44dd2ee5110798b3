"""Connection status of equipment as time passes: keyed state with timers.

Each equipment has one state entry, its newest reading, and a timer at the
moment that reading is too old. A reading makes the equipment ONLINE, or leaves
it OFFLINE if it is already too old when it arrives; the timer makes it OFFLINE
when no newer reading came. Readings that arrive out of order, however late, only
count if they are the newest of their equipment.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VALUES = ["voltage_avg", "current_avg", "power_active", "power_factor", "frequency", "temperature"]
_READING = "monitoring_us long, monitoring_id long, " + ", ".join(f"{v} double" for v in VALUES)
OUTPUT = f"equipment_id long, {_READING}, connection_status string, version long"


class ConnectionStatus(StatefulProcessor):
    """``lag_ms``: how far the readings' clock is behind the machine's (0 for a live feed)."""

    def __init__(self, online_ms: int, lag_ms: int = 0):
        self.online_ms, self.lag_ms = online_ms, lag_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", f"{_READING}, version long, due long")

    def _row(self, key, state, status) -> Row:
        return Row("equipment_id", "monitoring_us", "monitoring_id", *VALUES, "connection_status", "version")(
            key[0], *state[:-2], status, state[-2])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a key's rows come one by one; only the newest one is held
        best = tuple(max(rows, key=lambda r: (r[1], r[2])))[1:]
        old = self.newest.get()
        if old is not None and tuple(old[:2]) >= best[:2]:
            return
        if old is not None and old[-1]:
            self.handle.deleteTimer(old[-1])
        due = best[0] // 1000 + self.online_ms + self.lag_ms
        live = due > timerValues.getCurrentProcessingTimeInMs()
        state = (*best, (old[-2] if old is not None else 0) + 1, due if live else 0)
        if live:
            self.handle.registerTimer(due)
        self.newest.update(state)
        yield self._row(key, state, "ONLINE" if live else "OFFLINE")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        old = self.newest.get()
        if old is None or old[-1] != expiredTimerInfo.getExpiryTimeInMs():
            return  # a newer reading moved the timer
        state = (*old[:-2], old[-2] + 1, 0)
        self.newest.update(state)
        yield self._row(key, state, "OFFLINE")

    def close(self) -> None:
        pass


def connection_status(readings: DataFrame, online_minutes: float = 10, lag_ms: int = 0) -> DataFrame:
    """Stream of status changes from a stream of DWD readings (``equipment.reading_facts``). Readings without an
    equipment or a time take no part."""
    src = readings.where("equipment_id IS NOT NULL AND monitoring_time IS NOT NULL").select(
        F.col("equipment_id").cast("long").alias("equipment_id"),
        F.unix_micros(F.to_timestamp("monitoring_time")).alias("monitoring_us"),
        F.coalesce("monitoring_id", F.lit(-1)).cast("long").alias("monitoring_id"), *[F.col(v).cast("double").alias(v) for v in VALUES])
    return src.groupBy("equipment_id").transformWithState(
        statefulProcessor=ConnectionStatus(int(online_minutes * 60_000), lag_ms), outputStructType=OUTPUT,
        outputMode="Update", timeMode="ProcessingTime")


class LiveStatus:
    """Keeps the newest status row of each equipment under ``root``."""

    def __init__(self, spark: SparkSession, root: str, online_minutes: float = 10, lag_ms: int = 0):
        self.spark, self.root, self.online_minutes, self.lag_ms = spark, root, online_minutes, lag_ms

    def start(self, readings: DataFrame, **trigger):
        """Start the standing query. ``availableNow=True`` processes what is there and stops: batches without data,
        in which a standing query's timers run, would never end there and are left out."""
        out = f"{self.root}/status"

        def land(batch: DataFrame, no: int) -> None:  # a repeated batch overwrites itself
            batch.write.mode("overwrite").parquet(f"{out}/batch_no={no}")
        conf = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
                "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
                "spark.sql.streaming.noDataMicroBatches.enabled": str(not trigger.get("availableNow", False)).lower()}
        before = {k: self.spark.conf.get(k, None) for k in conf}
        for k, v in conf.items():
            self.spark.conf.set(k, v)
        try:  # the query keeps the settings it starts with
            return (connection_status(readings, self.online_minutes, self.lag_ms).writeStream.outputMode("update")
                    .option("checkpointLocation", f"{self.root}/checkpoint").foreachBatch(land).trigger(**trigger).start())
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def status(self, as_of: dt.datetime | None = None) -> DataFrame:
        """equipment_id, the newest reading and the status last reported of it, or, with ``as_of``, its status then."""
        rows = self.spark.read.schema(f"{OUTPUT}, batch_no long").option("basePath", f"{self.root}/status").parquet(f"{self.root}/status")
        top = rows.groupBy("equipment_id").agg(F.max_by(F.struct("monitoring_us", *VALUES, "connection_status"), "version").alias("t"))
        status = F.col("t.connection_status")
        if as_of is not None:
            since = int(as_of.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000) - int(self.online_minutes * 60_000_000)
            status = F.when(F.col("t.monitoring_us") > since, "ONLINE").otherwise("OFFLINE")
        return top.select("equipment_id", F.timestamp_micros("t.monitoring_us").cast("timestamp_ntz").alias("monitoring_time"),
                          *[F.col(f"t.{v}").alias(v) for v in VALUES], status.alias("connection_status"))
