"""Standing jobs: timers, partials per bucket, ranks from a histogram, digests, metrics of running batches."""

import datetime as dt
import os
import random
import tempfile
import time

from pyspark.sql import functions as F

from tidemark.operators import digests
from tidemark.operators import tickets as T
from tidemark.streaming import job_monitor as JM
from tidemark.streaming.live_status import VALUES, LiveStatus
from tidemark.streaming.partials import ticket_metrics_job
from tidemark.streaming.rank_totals import ranks_of

T0 = dt.datetime(2024, 1, 10, 8, 0, 0)


def _tmp():
    return tempfile.mkdtemp(prefix="tidemark-test-")


def test_status_turns_offline_when_nothing_comes(spark):
    """The timer of an equipment fires without a new reading of it; late readings do not bring it back."""
    root = _tmp()
    schema = "equipment_id long, monitoring_id long, monitoring_time timestamp_ntz, " + ", ".join(f"{v} double" for v in VALUES)

    def land(name, rows):
        spark.createDataFrame([(e, i, t, 1.0, None, 3.0, 4.0, 5.0, 6.0) for e, i, t in rows], schema).coalesce(1).write.parquet(f"{root}/in/{name}")
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    hour = dt.timedelta(hours=1)
    land("a=1", [(1, 1, now + dt.timedelta(seconds=25)), (2, 2, now - hour), (3, 3, now + hour), (None, 4, now), (4, 5, None)])
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    live = LiveStatus(spark, f"{root}/job", online_minutes=0.01)
    q = live.start(stream, processingTime="1 second")

    def status():
        return {r.equipment_id: (r.connection_status, r.monitoring_time) for r in live.status().collect()}
    try:
        def wait(done):
            until = time.time() + 120
            while time.time() < until and q.isActive:
                if os.path.exists(f"{root}/job/status") and any(f.startswith("batch_no") for f in os.listdir(f"{root}/job/status")):
                    if done(status()):
                        return status()
                time.sleep(1)
            raise AssertionError((status(), q.exception()))
        first = wait(lambda s: len(s) == 3)
        assert first[2][0] == "OFFLINE" and first[3][0] == "ONLINE"
        land("a=2", [(2, 6, now - 2 * hour), (3, 7, now - hour)])  # late: neither is the newest
        last = wait(lambda s: s[1][0] == "OFFLINE")               # no reading of 1 came
        assert last[3] == ("ONLINE", now + hour) and last[2] == ("OFFLINE", now - hour)
        assert {r.equipment_id: r.connection_status for r in live.status(now + 2 * hour).collect()} == dict.fromkeys((1, 2, 3), "OFFLINE")
    finally:
        q.stop()


def test_partials_of_touched_buckets_only(spark):
    job = ticket_metrics_job(spark, _tmp(), buckets=8)
    schema = "op string, seq long, ticket_id long, status string, created_at timestamp_ntz, closed_at timestamp_ntz"

    def row(op, seq, i, status, minutes=None):
        return (op, seq, i, status, T0, None if minutes is None else T0 + dt.timedelta(minutes=minutes))
    batches = [[row("c", 1, i, "pending") for i in range(30)], [row("u", 2, 3, "closed", 50), row("u", 2, 4, None)],
               [row("d", 3, 3, None), row("u", 1, 4, "closed", 9)], [row("d", 9, i, None) for i in range(30)]]
    for b, rows in enumerate(batches):
        for _ in range(2 if b == 1 else 1):
            job.process_batch(spark.createDataFrame(rows, schema), b)
        want = T.ticket_metrics(job.table.read(), T0).drop("metric_time").collect()[0]
        got = job.result().collect()[0].asDict()
        assert got == {k: v or (None if k.startswith("avg") else 0) for k, v in want.asDict().items()}, b
    assert job.partials.log(0).where("batch_id = 1").count() <= 2 and job.partials.read().count() == 0


def test_ranks_from_counts(spark):
    rng = random.Random(3)
    values = [rng.choice([None, 0, 0, 0, rng.randrange(40), rng.randrange(10**6)]) for _ in range(900)]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    counts = rows.groupBy("v").agg(F.count("*").alias("n"))
    for bins in (1, 4, 64):
        got = {r.v: r["rank"] for r in ranks_of(counts, "v", bins=bins).collect()}
        assert got == {v: 1 + sum(w is not None and (v is None or w > v) for w in values) for v in set(values)}
    assert ranks_of(counts.limit(0), "v").count() == 0


def test_digests_name_the_keys_that_differ(spark):
    a = [(i, f"v{i % 5}", None if i % 7 == 0 else float(i)) for i in range(300)] + [(None, "n", 1.0), (5, "twice", 0.0), (5, "twice", 0.0)]
    b = [r for r in a if r[0] not in (10, 20)] + [(1000, "more", 1.0), (30, "v0", 30.0)]
    b = [(r[0], "other", r[2]) if r[0] == 40 else r for r in b]
    b[50], b[60] = (b[50][0], b[60][1], b[50][2]), (b[60][0], b[50][1], b[60][2])  # two rows swap a value: counts agree
    swapped = {b[50][0], b[60][0]} if b[50][1] != b[60][1] else set()
    schema = "id long, s string, x double"
    src, sink = spark.createDataFrame(a, schema), spark.createDataFrame(b[::-1], schema)
    got = {r.id: (r.difference, r.source_rows, r.sink_rows) for r in digests.differing_keys(src, sink, ["id"], ranges=16).collect()}
    want = {10: ("missing", 1, 0), 20: ("missing", 1, 0), 1000: ("unexpected", 0, 1), 30: ("different", 1, 2), 40: ("different", 1, 1)}
    assert got == want | {i: ("different", 1, 1) for i in swapped}
    assert digests.differing_ranges(src, src.repartition(7), ["id"], src.columns).count() == 0
    assert digests.differing_keys(src.limit(0), src.limit(0), ["id"]).count() == 0


def test_batches_are_measured(spark):
    root = _tmp()
    rows = spark.createDataFrame([(i, None if i == 3 else T0 + dt.timedelta(minutes=i)) for i in range(10)], "id long, at timestamp_ntz")
    rows.coalesce(2).write.parquet(f"{root}/in")
    monitor = JM.JobMonitor()
    spark.streams.addListener(monitor)
    try:
        stream = JM.observed(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), "at")
        q = (stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/c")
             .queryName("measured").trigger(availableNow=True).start())
        q.awaitTermination()
        until = time.time() + 30
        while sum(r[2] for r in monitor.rows) < 10 and time.time() < until:
            time.sleep(.2)
    finally:
        spark.streams.removeListener(monitor)
    table = monitor.table(spark)
    one = table.agg(F.sum("rows").alias("n"), F.sum("rows_without_time").alias("u"), F.max("newest_event").alias("t"),
                    F.min("batch_ms").alias("ms")).collect()[0]
    assert (one.n, one.u, one.ms > 0) == (10, 1, True) and one.t == T0 + dt.timedelta(minutes=9)
    assert JM.throughput(table).agg(F.sum("records_per_minute")).collect()[0][0] == 10
    assert JM.batches_of(spark, q, "x").agg(F.sum("rows")).collect()[0][0] == 10
    monitor.flush(spark, f"{root}/log")
    assert monitor.rows == [] and spark.read.parquet(f"{root}/log").count() == table.count()
