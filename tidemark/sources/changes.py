"""Change streams: derive change rows from the bound tables, stage them as
files, and read them back with Structured Streaming.

Log decoding from a database (replication slots) is outside Spark; a change
feed lands as files (or on a message bus) and is read here. A Kafka source is a
drop-in replacement for ``read_change_stream`` where its package is installed.
"""

from __future__ import annotations

import dataclasses
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import change_file_options, open_files
from tidemark.sources import bind
from tidemark.sources.tables import Tables

# One envelope for the order chain's source tables, so a single stream (one
# foreachBatch, one batch id sequence) carries users and orders changes.
ENVELOPE = T.StructType([
    T.StructField("tbl", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("username", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("order_amount", T.DecimalType(12, 2)),
    T.StructField("order_status", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("event_time", T.TimestampNTZType()),
])


def _envelope(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in ENVELOPE.fields], *more)


def _versions(rows: DataFrame, *versions: dict) -> DataFrame:
    """Every row once for each version, with the columns that the version sets: the rows are made once for all of them."""
    names = list(dict.fromkeys(c for v in versions for c in v))
    columns = list(dict.fromkeys([*rows.columns, *names]))
    numbered = rows.withColumn("_v", F.explode(F.array(*[F.lit(k) for k in range(len(versions))])))

    def of_version(c):  # picked by the version's number: no rows of all versions are put together first
        out = None
        for k, v in enumerate(versions[:-1]):
            out = (F if out is None else out).when(F.col("_v") == k, v.get(c, F.col(c)))
        last = versions[-1].get(c, F.col(c))
        return (last if out is None else out.otherwise(last)).alias(c)
    return numbered.select(*[of_version(c) if c in names else F.col(c) for c in columns])


@dataclasses.dataclass(frozen=True)
class Versions:
    """A change log before its versions are made: the rows, the columns that each version of a row sets, and the key by
    which the rows are dealt to files - once each, not once a version. A version without an ``op`` is none. ``timed`` has
    what the versions' event times are made of, from fewer columns or joins; without it, the rows have it. Rows that
    cost more to make than to read from a file are to ``settle``: they are written once for the bounds and the files."""

    rows: DataFrame
    versions: list[dict]
    key: list[str]
    timed: DataFrame | None = None
    settle: bool = False
    aside: tuple[str, ...] = ()  # columns of the rows that only the versions are made of

    def log(self, files: int | None = None) -> DataFrame:
        """The change log, its rows dealt to ``files`` partitions."""
        rows = self.rows.repartition(files, *self.key) if files else self.rows
        return _versions(rows, *self.versions).where("op IS NOT NULL").drop(*self.aside)

    def settled(self, path: str) -> Versions:
        """The same with its rows read from files under ``path``, where they are written first."""
        self.rows.write.mode("overwrite").options(**change_file_options(self.rows)).parquet(path)
        return dataclasses.replace(self, rows=self.rows.sparkSession.read.schema(self.rows.schema).parquet(path))

    def times(self) -> DataFrame:
        rows = self.rows if self.timed is None else self.timed
        return _versions(rows, *[{"event_time": v["event_time"]} for v in self.versions]).select("event_time")

    @property
    def schema(self) -> T.StructType:
        return self.log().schema


def user_change_log(t: Tables) -> DataFrame:
    """One create per user at its creation time."""
    u = bind.users(t)
    return _envelope(u.select(F.lit("users").alias("tbl"), F.lit("c").alias("op"),
                              F.col("id").alias("seq"), "id", "username", "email", "created_at",
                              "updated_at", F.col("created_at").alias("event_time")))


def _order_rows(t: Tables) -> DataFrame:
    """The orders with the time their last line ships; without lines, they are created."""
    o = bind.orders(t)
    last_ship = t.lineitem.groupBy(F.col("l_orderkey").alias("lo")).agg(F.max("l_shipdate").alias("shipped"))
    return o.join(last_ship, o.id == last_ship.lo, "left").select(
        F.lit("orders").alias("tbl"), *[c for c in o.columns if c != "updated_at"], F.coalesce(F.col("shipped"), F.col("created_at")).alias("shipped"))


def _order_versions(rows: DataFrame) -> Versions:
    """Two versions of an order, one of any other row: as it is at its creation."""
    order = F.col("tbl") == "orders"
    create = {"op": F.lit("c"), "seq": F.when(order, F.col("id") * 2).otherwise(F.col("id")),
              "order_status": F.when(order, F.lit("pending")), "updated_at": F.when(order, F.col("created_at")).otherwise(F.col("updated_at")),
              "event_time": F.col("created_at")}
    final = {"op": F.when(order, F.when(F.col("order_status") == "cancelled", "d").otherwise("u")), "seq": F.col("id") * 2 + 1,
             "updated_at": F.col("shipped"), "event_time": F.col("shipped")}
    rows = _envelope(rows, "shipped")
    return Versions(rows, [create, final], ["tbl", "id"], settle=True, aside=("shipped",))


def order_change_log(t: Tables) -> DataFrame:
    """Order lifecycle from the data: created as 'pending' at the order date;
    final status when the order's last line ships (cancelled orders are
    deleted then). seq orders the two events of one order; the final event
    may arrive in an earlier batch than the create (ship date before order
    date), which exercises stale-change handling."""
    return _envelope(_order_versions(_order_rows(t)).log())


def chain_versions(t: Tables) -> Versions:
    """``user_change_log`` and ``order_change_log`` as one: the orders meet their lines once."""
    users = bind.users(t).withColumn("tbl", F.lit("users"))
    return _order_versions(_order_rows(t).unionByName(users, allowMissingColumns=True))


def chain_change_log(t: Tables) -> DataFrame:
    return user_change_log(t).unionByName(order_change_log(t))


def ticket_change_log(t: Tables) -> DataFrame:
    """Ticket lifecycle: created as 'pending', every tenth with another agent; its final state, and for every
    17th its deletion, when it is updated."""
    k = bind.tickets(t).withColumn("id", F.col("ticket_id"))
    later = F.col("agent_id") + F.when(F.col("id") % 10 == 1, 1).otherwise(0)
    none = F.lit(None).cast("timestamp_ntz")
    create = {"op": F.lit("c"), "seq": F.col("id") * 2, "event_time": F.col("created_at"), "agent_id": later,
              "status": F.lit("pending"), "updated_at": F.col("created_at"), "closed_at": none}
    final = {"op": F.when(F.col("id") % 17 == 0, "d").otherwise("u"), "seq": F.col("id") * 2 + 1, "event_time": F.col("updated_at")}
    return _versions(k, create, final)


def item_versions(t: Tables) -> Versions:
    """Order item lifecycle: created with one piece more, corrected ten days later; the items of every 13th order
    are deleted then."""
    i = bind.order_items(t).withColumn("id", F.col("order_id"))
    create = {"op": F.lit("c"), "seq": F.lit(1), "event_time": F.col("created_at"), "quantity": F.col("quantity") + 1}
    final = {"op": F.when(F.col("id") % 13 == 0, "d").otherwise("u"), "seq": F.lit(2),
             "event_time": F.timestamp_add("DAY", F.lit(10), F.col("created_at"))}
    # the part adds columns only: the bounds of the ranges come from the lines
    return Versions(i, [create, final], ["order_id", "l_linenumber", "item_partkey", "item_suppkey", "created_at"],
                    t.lineitem.select(F.col("l_shipdate").alias("created_at")))


def item_change_log(t: Tables) -> DataFrame:
    return item_versions(t).log()


def grid_change_log(t: Tables) -> DataFrame:
    """Dispatches and devices in one stream, by their source columns. A dispatch is created 100 MW short of its
    demand and confirmed two hours later; every 19th is deleted then. A device is created at its installation, hotter
    and less efficient than it ends; its last change falls among the dispatches, every 23rd is removed by it."""
    d = bind.dispatch_feed(t).withColumns({"tbl": F.lit("dispatch"), "id": F.col("dispatch_id")})
    v = bind.devices(t).withColumns({"tbl": F.lit("device"), "id": F.col("device_id")})
    last = F.timestamp_add("DAY", (F.col("id") % 29).cast("int"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    parts = [
        d.withColumns({"op": F.lit("c"), "seq": F.col("id") * 2, "event_time": F.col("dispatch_time"),
                       "load_demand_mw": F.col("load_demand_mw") - 100, "emergency_level": F.lit("NORMAL")}),
        d.withColumns({"op": F.when(F.col("id") % 19 == 0, "d").otherwise("u"), "seq": F.col("id") * 2 + 1,
                       "event_time": F.timestamp_add("HOUR", F.lit(2), F.col("dispatch_time"))}),
        v.withColumns({"op": F.lit("c"), "seq": F.col("id") * 2, "event_time": F.col("installation_date"),
                       "efficiency_rate": F.col("efficiency_rate") - 0.1,
                       "real_time_temperature": F.col("real_time_temperature") + 30}),
        v.withColumns({"op": F.when(F.col("id") % 23 == 0, "d").otherwise("u"), "seq": F.col("id") * 2 + 1, "event_time": last})]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def alarm_change_log(t: Tables) -> DataFrame:
    """Alarms and readings of equipment in one stream. An alarm is raised at the lowest level and graded half an hour
    later, every 29th is withdrawn then. Every seventh reading arrives six hours late; every eleventh arrives too cold
    and is corrected a day later, every 31st is withdrawn then."""
    a = bind.alarms(t).select("alarm_id", "equipment_id", "alarm_level", "occurred_at").withColumns(
        {"tbl": F.lit("alarm"), "id": F.col("alarm_id")})
    r = bind.monitoring(t).withColumns({"tbl": F.lit("reading"), "id": F.col("monitoring_id")})
    hours = F.when(F.col("id") % 7 == 0, 6).otherwise(0)
    arrives = F.timestamp_add("HOUR", hours, F.col("monitoring_time"))
    wrong = F.when(F.col("id") % 11 == 0, F.col("temperature") - 40).otherwise(F.col("temperature"))
    parts = [
        a.withColumns({"op": F.lit("c"), "seq": F.col("id") * 2, "event_time": F.col("occurred_at"),
                       "alarm_level": F.lit(1).cast("int")}),
        a.withColumns({"op": F.when(F.col("id") % 29 == 0, "d").otherwise("u"), "seq": F.col("id") * 2 + 1,
                       "event_time": F.timestamp_add("MINUTE", F.lit(30), F.col("occurred_at"))}),
        r.withColumns({"op": F.lit("c"), "seq": F.col("id") * 2, "event_time": arrives, "temperature": wrong}),
        r.where("id % 11 = 0 OR id % 31 = 0").withColumns({
            "op": F.when(F.col("id") % 31 == 0, "d").otherwise("u"), "seq": F.col("id") * 2 + 1,
            "event_time": F.timestamp_add("DAY", F.lit(1), F.col("monitoring_time"))})]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


ROWS_PER_FILE = 400_000  # of a staged change file; what a task writes


def stage_change_files(changes: DataFrame | Versions, path: str, n_batches: int, files_per_batch: int = 4) -> int:
    """Land the change log as ``n_batches`` consecutive event-time ranges, each
    written as ``files_per_batch`` files, or more where a file would pass
    ``ROWS_PER_FILE`` (landed range by range, so file modification times follow
    event time, as a change feed lands). Returns the number of files of a range:
    read with it as ``maxFilesPerTrigger`` for one range per micro-batch.

    The range boundaries are ``n_batches − 1`` approximate quantiles of the
    event time (a handful of numbers on the driver), found with the number of rows
    in one pass over the event times. One job then deals the rows to the files:
    a task writes a file of every range. Rows without an event time land with the
    last range."""
    if isinstance(changes, Versions) and changes.settle:
        changes = changes.settled(f"{path.rstrip('/')}-rows")
    at, times = F.col("event_time"), changes.times() if isinstance(changes, Versions) else changes
    spark, kind = times.sparkSession, times.schema["event_time"].dataType
    probs = [i / n_batches for i in range(1, n_batches)]
    # the few cuts are turned to numbers, not the times
    cuts = F.transform(F.percentile_approx(at, probs, 1000), lambda t: F.unix_micros(F.to_timestamp(t))) if probs else F.lit(None)
    rows, cuts = times.agg(F.count(F.lit(1)), cuts).first()
    files = max(files_per_batch, -(-rows // (n_batches * ROWS_PER_FILE)))
    cuts = cuts or []  # without any event time there are no cuts and one range
    place = F.lit(0)
    for cut in cuts:
        place = place + F.when(at <= F.timestamp_micros(F.lit(cut)).cast(kind), 0).otherwise(1)
    dealt = f"{path.rstrip('/')}-dealt"
    rows = changes.log(files) if isinstance(changes, Versions) else changes.repartition(files, "id", "seq")
    with open_files(rows.sparkSession):
        (rows.withColumn("_range", place).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_range")
         .options(**change_file_options(rows)).parquet(dealt))
    _land(spark, dealt, path, len(cuts) + 1)
    return files


def _land(spark: SparkSession, dealt: str, path: str, ranges: int) -> None:
    """Move the files of each range from its folder to ``path``, dated in the order of the ranges."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    to = Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(to)
    began = int(time.time() * 1000) - ranges
    for k in range(ranges):
        folder = Path(f"{dealt}/_range={k}")
        for st in fs.listStatus(folder) if fs.exists(folder) else []:
            file = Path(to, f"range-{k:05d}-{st.getPath().getName()}")
            if not fs.rename(st.getPath(), file):
                raise OSError(f"could not land {file}")
            fs.setTimes(file, began + k, -1)


def read_change_stream(spark: SparkSession, path: str, schema: T.StructType = ENVELOPE,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)
