"""PK table, change streams and incremental maintenance (stream = batch)."""

import datetime as dt
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changes as C
from tidemark.operators import orders as O
from tidemark.operators import scenarios as S
from tidemark.sources import bind
from tidemark.sources import changes as CH
from tidemark.sources.tables import Tables
from tidemark.streaming import sinks as K
from tidemark.streaming.incremental import DWD_COLS, DWS_COLS, OrdersChain, latest_per_key_stream, run_chain_from_tables
from tidemark.streaming.pktable import PKTable

TS = dt.datetime(2024, 1, 30, 10, 0, 0)
D = dt.date(2001, 8, 1)


def _tmp():
    return tempfile.mkdtemp(prefix="tidemark-test-")


def _ch(spark, rows):
    return spark.createDataFrame(rows, "op string, seq long, id long, v string")


def test_pktable_upsert_time_travel_compaction(spark):
    t = PKTable(spark, os.path.join(_tmp(), "t"), ["id"], buckets=3)
    t.write_batch(_ch(spark, [("c", 1, 1, "a"), ("c", 2, 2, "b"), ("c", 3, 3, "c")]), 0)
    t.write_batch(_ch(spark, [("u", 4, 1, "a2"), ("d", 5, 2, None)]), 1)
    t.write_batch(_ch(spark, [("u", 4, 1, "a2"), ("d", 5, 2, None)]), 1)  # retried batch: idempotent
    t.write_batch(_ch(spark, [("u", 1, 2, "stale")]), 2)  # stale update must not resurrect id 2
    state = lambda df: sorted((r.id, r.v) for r in df.collect())
    assert state(t.read()) == [(1, "a2"), (3, "c")]
    assert state(t.as_of(0)) == [(1, "a"), (2, "b"), (3, "c")]
    assert t.compact(1) == 1
    t.write_batch(_ch(spark, [("u", 9, 3, "c2")]), 3)
    assert state(t.read()) == [(1, "a2"), (3, "c2")]
    assert state(t.as_of(1)) == [(1, "a2"), (3, "c")]
    assert state(t.lookup([3, 2])) == [(3, "c2")]


def test_pktable_ignores_what_was_not_committed(spark):
    path = os.path.join(_tmp(), "t")
    t = PKTable(spark, path, ["id"], buckets=2)
    t.write_batch(_ch(spark, [("c", i, i, "a") for i in range(20)]), 0)
    t.compact()
    t.write_batch(_ch(spark, [("u", 50, 1, "b")]), 1)
    os.remove(os.path.join(path, "snapshot", "version=0", "_SUCCESS"))  # a snapshot that died half way
    os.makedirs(os.path.join(path, "snapshot", "version=1"))
    os.makedirs(os.path.join(path, "log", "batch_id=2", "writer=main"))
    assert t.read().count() == 20 and t.read().where("id = 1").first().v == "b"
    os.remove(os.path.join(path, "log", "batch_id=1", "writer=main", "_SUCCESS"))
    assert t.read().where("id = 1").first().v == "a"


def test_pktable_restart_writers_and_types(spark):
    path = os.path.join(_tmp(), "t")
    PKTable(spark, path, ["id"], buckets=4).write_batch(_ch(spark, [("c", i, i, str(i)) for i in range(10)]), 0)
    again = PKTable(spark, path, ["id"], buckets=4)  # a new process: its first batch has no value columns
    again.write_batch(spark.createDataFrame([("d", 100, 3)], "op string, seq long, id int"), 1, writer="expire")
    again.write_batch(_ch(spark, [("u", 101, 4, "four")]), 1)  # same batch number, another writer
    state = {r.id: r.v for r in again.read().collect()}
    assert state == {i: str(i) for i in range(10) if i not in (3, 4)} | {4: "four"}
    ints = PKTable(spark, os.path.join(_tmp(), "i"), ["id"], buckets=8)
    ints.write_batch(spark.createDataFrame([("c", i, i) for i in range(10)], "op string, seq long, id int"), 0)
    assert sorted(r.id for r in ints.lookup(list(range(10))).collect()) == list(range(10))
    pair = PKTable(spark, os.path.join(_tmp(), "p"), ["u", "o"], buckets=8, bucket_keys=["u"])
    pair.write_batch(spark.createDataFrame([("c", i, i % 3, i) for i in range(10)], "op string, seq long, u long, o long"), 0)
    assert sorted((r.u, r.o) for r in pair.lookup([(i % 3, i) for i in range(10)]).collect()) == sorted(
        (i % 3, i) for i in range(10))


def test_pktable_files_stay_flat_with_compaction(spark):
    path = os.path.join(_tmp(), "t")
    t = PKTable(spark, path, ["id"], buckets=2)
    listed = []
    for b in range(30):
        t.write_batch(_ch(spark, [("c", b, b, "x"), ("d", b + 100, b - 5, None)]), b)
        if b % 5 == 4:
            t.compact(expire=True, drop_tombstones=True)
        listed.append(sum(len(f) for _, _, f in os.walk(path)))
    assert max(listed[15:]) <= 1.2 * max(listed[5:15])
    assert sorted(r.id for r in t.read().collect()) == list(range(25, 30))


def test_upsert_row_wins_at_equal_seq(spark):
    state = spark.createDataFrame([(i, 5, "old") for i in range(40)], "id long, seq long, v string")
    rows = spark.createDataFrame([(i, 5, "new") for i in range(40)], "id long, seq long, v string")
    assert {r.v for r in C.upsert(state, rows, ["id"]).collect()} == {"new"}


def test_tier_cycle_keeps_archived_rows(spark):
    from tidemark.streaming.jobs import tier_cycle
    cols = ("op string, seq long, ticket_id long, customer_id long, agent_id long, title string, priority string, "
            "status string, category string, created_at timestamp_ntz, updated_at timestamp_ntz, closed_at timestamp_ntz")
    day = dt.datetime(2024, 1, 10, 8)

    def row(i, seq, status, at=day):
        return ("c", seq, i, 1, 1, "t", "low", status, "x", at, at, None)
    base = _tmp()
    cold = f"{base}/cold"
    hot = PKTable(spark, f"{base}/hot", ["ticket_id"], buckets=2)
    now = dt.datetime(2024, 1, 30)
    hot.write_batch(spark.createDataFrame([row(i, 1, "open") for i in range(10)] + [row(99, 1, "open", now)], cols), 0)
    assert tier_cycle(hot, cold, now, version=0)["archived"] == 10
    # a late ticket and an update of an archived day; the cycle uses a batch number that ingest uses too
    hot = PKTable(spark, f"{base}/hot", ["ticket_id"], buckets=2)
    hot.write_batch(spark.createDataFrame([row(50, 1, "open"), row(3, 9, "closed")], cols), 1)
    assert tier_cycle(hot, cold, now, version=1)["archived"] == 2
    got = {r.ticket_id: r.status for r in spark.read.parquet(cold).collect()}
    assert got == {i: "open" for i in (*range(10), 50)} | {3: "closed"}
    assert [r.ticket_id for r in hot.read().collect()] == [99]
    assert tier_cycle(hot, cold, now, version=2)["archived"] == 0
    # a cycle that died while switching: its stage is replayed
    spark.read.parquet(cold).write.parquet(cold + "-stage")
    spark.read.parquet(cold + "-stage").where("ticket_id < 4").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("archive_date").parquet(cold)
    tier_cycle(hot, cold, now, version=3)
    assert spark.read.parquet(cold).count() == 11


def test_restricted_read_equals_filtered_full_read(spark):
    t = PKTable(spark, os.path.join(_tmp(), "t"), ["id"], buckets=8)
    t.write_batch(_ch(spark, [("c", i, i, str(i)) for i in range(50)]), 0)
    only = spark.createDataFrame([(3,), (17,), (42,)], "id long")
    a = sorted(tuple(r) for r in t.as_of(0, only).collect())
    b = sorted(tuple(r) for r in t.read().where(F.col("id").isin(3, 17, 42)).collect())
    assert a == b and len(a) == 3


def _envelope_rows(spark, rows):
    return spark.createDataFrame(rows, CH.ENVELOPE)


def _u(uid, seq, name, op="c"):
    return ("users", op, seq, uid, None, name, f"{name}@x", None, None, TS, TS, TS)


def _o(oid, seq, uid, amt, status, op="c"):
    from decimal import Decimal
    return ("orders", op, seq, oid, uid, None, None, Decimal(amt), status, TS, TS, TS)


def test_chain_retractions(spark):
    chain = OrdersChain(spark, os.path.join(_tmp(), "chain"), buckets=3, as_of=D)
    chain.process_batch(_envelope_rows(spark, [
        _u(1, 1, "ann"), _u(2, 2, "bob"), _u(3, 3, "cid"),
        _o(10, 10, 1, "100.00", "completed"), _o(11, 11, 1, "50.00", "completed"), _o(12, 12, 2, "70.00", "completed")]), 0)
    # order 11 moves to user 2; order 12 goes pending (user 2 still has 11); user 1 renamed
    chain.process_batch(_envelope_rows(spark, [
        _o(11, 20, 2, "50.00", "completed", "u"), _o(12, 21, 2, "70.00", "pending", "u"), _u(1, 22, "anna", "u")]), 1)
    s = {r.user_id: r for r in chain.user_stats().collect()}
    assert s[1].username == "anna" and s[1].total_orders == 1 and s[1].total_amount == 100.0
    assert s[2].total_orders == 1 and s[2].total_amount == 50.0
    assert s[3].total_orders == 0
    # the rename rewrote the old fact row
    assert {r.username for r in chain.dwd_orders.read().where(F.col("order_id") == 10).collect()} == {"anna"}
    # delete the last kept order of user 2 → user 2 has only a pending order → vanishes
    chain.process_batch(_envelope_rows(spark, [_o(11, 30, 2, "50.00", "completed", "d")]), 2)
    s = {r.user_id for r in chain.user_stats().collect()}
    assert s == {1, 3}
    # re-running the same batch id changes nothing
    chain.process_batch(_envelope_rows(spark, [_o(11, 30, 2, "50.00", "completed", "d")]), 2)
    assert {r.user_id for r in chain.user_stats().collect()} == {1, 3}


@pytest.mark.parametrize("n_batches", [1, 2])
def test_chain_stream_equals_batch(spark, sf_small, n_batches):
    # (3 batches: the registered incremental_user_stats query, checked against its oracle)
    t = Tables(spark, sf_small)
    chain = run_chain_from_tables(spark, t, n_batches=n_batches, files_per_batch=2)
    got = sorted(tuple(r) for r in chain.user_stats().collect())
    final = bind.orders(t).where(F.col("order_status") != "cancelled")
    exp = O.user_stats_left(O.dwd_users(bind.users(t), D), O.dwd_orders(final, bind.users(t), D), D)
    assert got == sorted(tuple(r) for r in exp.select(*DWS_COLS).collect())


def test_streaming_latest_per_key_equals_batch(spark, sf_small):
    t = Tables(spark, sf_small)
    src = os.path.join(_tmp(), "changes")
    log = bind.change_log(t)
    log.repartitionByRange(3, "ts").write.parquet(src)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = "latest_" + uuid.uuid4().hex[:8]
    q = (latest_per_key_stream(stream, ["id"]).writeStream.outputMode("update").format("memory")
         .queryName(name).option("checkpointLocation", os.path.join(_tmp(), "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    emitted = spark.table(name)
    final = C.latest_changes(emitted.withColumn("_ord", F.monotonically_increasing_id()), ["id"], "seq", "op")
    got = sorted((r.id, r.seq) for r in final.where(F.col("op") != "d").collect())
    exp = sorted((r.id, r.seq) for r in C.apply_changes(log, ["id"]).collect())
    assert got == exp


def test_alarm_status_stream_join(spark):
    base = _tmp()
    alarms = spark.createDataFrame([(1, 7, TS), (2, 7, TS + dt.timedelta(hours=2)), (3, 8, TS)],
                                   "alarm_id long, equipment_id long, occurred_at timestamp")
    reads = spark.createDataFrame([(i, 7 if i % 2 else 8, TS + dt.timedelta(minutes=3 * i), 60.0, 0.9)
                                   for i in range(50)],
                                  "monitoring_id long, equipment_id long, monitoring_time timestamp, "
                                  "temperature double, power_factor double")
    alarms.write.parquet(f"{base}/a")
    reads.write.parquet(f"{base}/r")
    sa = spark.readStream.schema(alarms.schema).parquet(f"{base}/a")
    sr = spark.readStream.schema(reads.schema).parquet(f"{base}/r")
    name = "asj_" + uuid.uuid4().hex[:8]
    q = (S.alarm_status_join_stream(sa, sr).writeStream.format("memory").queryName(name)
         .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.alarm_id, r.monitoring_id) for r in spark.table(name).collect())
    exp = sorted((r.alarm_id, r.monitoring_id) for r in S.range_join(
        alarms, reads, "equipment_id", "occurred_at", "monitoring_time", 10, 10).collect())
    assert got == exp and len(exp) > 0


def test_multi_sink_and_refresh(spark):
    base = _tmp()
    df = spark.createDataFrame([(1, "SYNC_1"), (2, "CDC_2"), (3, "SYNCX3")], "k long, sid string")
    K.multi_sink(df, 5, [K.parquet_sink(f"{base}/a"), K.parquet_sink(f"{base}/b", lambda d: d.where("k > 1"))])
    K.multi_sink(df, 5, [K.parquet_sink(f"{base}/a")])  # retried batch replaces itself
    assert spark.read.parquet(f"{base}/a").count() == 3 and spark.read.parquet(f"{base}/b").count() == 2
    fresh = spark.createDataFrame([(9, "SYNC_9")], "k long, sid string")
    kept = sorted(r.sid for r in K.prefix_refresh(df, fresh, "sid", "SYNC_").collect())
    assert kept == ["CDC_2", "SYNCX3", "SYNC_9"]  # a literal prefix: SYNCX3 is not a SYNC_ row
    K.full_refresh(df, f"{base}/fr", 1)
    K.full_refresh(fresh, f"{base}/fr", 2)
    assert [r.k for r in K.read_latest(spark, f"{base}/fr").collect()] == [9]


def test_upsert_statements():
    pg = K.upsert_statement("postgres", "t", "s", ["id"], ["id", "a", "b"])
    assert pg == ("INSERT INTO t (id, a, b) SELECT id, a, b FROM s ON CONFLICT (id) "
                  "DO UPDATE SET a = EXCLUDED.a, b = EXCLUDED.b")
    assert "ON DUPLICATE KEY UPDATE a = VALUES(a)" in K.upsert_statement("mysql", "t", "s", ["id"], ["id", "a"])
    m = K.upsert_statement("ansi", "t", "s", ["id", "d"], ["id", "d", "a"])
    assert m.startswith("MERGE INTO t t USING s s ON (t.id = s.id AND t.d = s.d) WHEN MATCHED THEN UPDATE SET a = s.a")
    assert "NOT EXISTS" in K.insert_ignore_statement("t", "s", ["id"], ["id", "a"])


def test_chain_with_compaction_equals_without(spark):
    rows0 = [_u(1, 1, "ann"), _u(2, 2, "bob"), _o(10, 10, 1, "100.00", "completed"),
             _o(11, 11, 2, "50.00", "pending")]
    rows1 = [_o(11, 20, 2, "50.00", "completed", "u"), _o(12, 21, 1, "7.00", "completed")]
    rows2 = [_o(10, 30, 1, "100.00", "completed", "d"), _u(2, 31, "bobby", "u")]
    out = []
    for every in (None, 1):
        chain = OrdersChain(spark, os.path.join(_tmp(), "c"), buckets=2, as_of=D, compact_every=every)
        for b, rows in enumerate((rows0, rows1, rows2)):
            chain.process_batch(_envelope_rows(spark, rows), b)
        out.append(sorted(tuple(r) for r in chain.user_stats().collect()))
    assert out[0] == out[1] and len(out[0]) == 2


def test_ingest_stream_into_pktable(spark, sf_small):
    from tidemark.streaming.jobs import ingest_stream
    t = Tables(spark, sf_small)
    log = bind.change_log(t)
    src = os.path.join(_tmp(), "src")
    log.repartitionByRange(3, "ts").write.parquet(src)
    table = PKTable(spark, os.path.join(_tmp(), "ods"), ["id"], buckets=4)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    ingest_stream(stream, table, os.path.join(_tmp(), "ck")).awaitTermination()
    got = sorted(tuple(r) for r in table.read().select("id", "seq", "status").collect())
    exp = sorted(tuple(r) for r in C.apply_changes(log, ["id"]).select("id", "seq", "status").collect())
    assert got == exp


def test_tier_cycle_commit_order(spark, sf_small):
    from tidemark.operators import tier as H
    from tidemark.streaming.jobs import tier_cycle
    t = Tables(spark, sf_small)
    as_of = dt.datetime(2024, 1, 30, 23, 59, 59)
    tickets = bind.tickets(t)
    hot = PKTable(spark, os.path.join(_tmp(), "hot"), ["ticket_id"], buckets=4)
    hot.write_batch(tickets.select(F.lit("c").alias("op"), F.col("ticket_id").alias("seq"), "*"), 0)
    cold = os.path.join(_tmp(), "cold")
    res = tier_cycle(hot, cold, as_of, version=1)
    exp_hot = H.expire_hot(tickets, as_of)
    assert res["archived"] == tickets.count() - exp_hot.count() > 0
    assert hot.read().count() == exp_hot.count()
    assert spark.read.parquet(cold).count() == res["archived"]
    tier_cycle(hot, cold, as_of, version=2)  # re-run: nothing left to archive, cold unchanged
    assert spark.read.parquet(cold).count() == res["archived"]


def test_continuous_sync_named_query(spark):
    base = _tmp()
    df = spark.createDataFrame([(i, f"r{i}") for i in range(20)], "k long, v string")
    df.repartition(4).write.parquet(f"{base}/src")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src")
    q = K.continuous_sync(stream, "sync_" + uuid.uuid4().hex[:6], K.parquet_sink(f"{base}/out"),
                          f"{base}/ck", available_now=True)
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    assert out.select("batch_id").distinct().count() >= 2  # several micro-batches
    assert sorted(r.k for r in out.collect()) == list(range(20))


def test_live_ticket_metrics_refresh(spark, sf_small):
    from tidemark.operators import tickets as T
    from tidemark.streaming.jobs import refresh_on_change
    t = Tables(spark, sf_small)
    as_of = dt.datetime(2024, 1, 30, 23, 59, 59)
    tickets = bind.tickets(t)
    # change rows: every ticket created, then a later status update for a third of them
    ch = tickets.select(F.lit("c").alias("op"), (F.col("ticket_id") * 2).alias("seq"), "*").unionByName(
        tickets.where(F.col("ticket_id") % 3 == 0).withColumn("status", F.lit("resolved")).select(
            F.lit("u").alias("op"), (F.col("ticket_id") * 2 + 1).alias("seq"), "*"))
    base = _tmp()
    ch.repartition(3).write.parquet(f"{base}/src")
    table = PKTable(spark, f"{base}/t", ["ticket_id"], buckets=4)
    stream = spark.readStream.schema(ch.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src")
    q = refresh_on_change(stream, table, lambda s: T.ticket_metrics(s.drop("op", "seq"), as_of),
                          K.parquet_sink(f"{base}/out"), f"{base}/ck")
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.where(F.col("batch_id") == out.agg(F.max("batch_id")).first()[0]).drop("batch_id")
    final = tickets.join(ch.where(F.col("op") == "u").select("ticket_id", F.col("status").alias("s2")),
                         "ticket_id", "left").withColumn("status", F.coalesce("s2", "status")).drop("s2")
    exp = T.ticket_metrics(final, as_of)
    assert [tuple(r) for r in last.collect()] == [tuple(r) for r in exp.select(*last.columns).collect()]


def test_chain_daily_partials_equal_batch(spark):
    rows0 = [_u(1, 1, "ann"), _u(2, 2, "bob"), _o(10, 10, 1, "100.00", "completed"),
             _o(11, 11, 2, "50.00", "pending"), _o(12, 12, 2, "5.00", "pending")]
    rows1 = [_o(11, 20, 2, "50.00", "completed", "u"), _o(13, 21, 1, "7.00", "completed")]
    rows2 = [_o(10, 30, 1, "100.00", "completed", "d"), _o(12, 31, 2, "5.00", "pending", "d")]
    chain = OrdersChain(spark, os.path.join(_tmp(), "c"), buckets=2, as_of=D, with_daily=True)
    for b, rows in enumerate((rows0, rows1, rows2)):
        chain.process_batch(_envelope_rows(spark, rows), b)
    final = chain.dwd_orders.read().select("order_id", "user_id", "order_amount", "order_status",
                                           "created_at", "updated_at")
    exp = O.daily_order_stats(final, D).drop("etl_time")
    got = sorted(tuple(r) for r in chain.daily_stats().collect())
    assert got == sorted(tuple(r) for r in exp.collect()) and got[0][1] == 2
    assert chain.dashboard().collect()[0].total_orders == 2.0


def test_append_log_stream_drops_redelivery(spark, sf_small):
    t = Tables(spark, sf_small)
    logs = bind.ticket_logs(t)
    base = _tmp()
    logs.write.parquet(f"{base}/src")
    # redelivery of the newest day, landing as later files
    logs.where(F.col("created_at") >= F.lit("2024-01-30").cast("timestamp_ntz")).write.mode("append") \
        .parquet(f"{base}/src")
    late = logs.limit(1).withColumn("log_id", F.lit(-1).cast(logs.schema["log_id"].dataType)).withColumn(
        "created_at", F.lit("1999-01-01").cast("timestamp_ntz"))  # a row of long ago with a new key is no repeat
    late.write.mode("append").parquet(f"{base}/src")
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/src")
    name = "logs_" + uuid.uuid4().hex[:6]
    q = (C.append_log_stream(stream).writeStream.format("memory").queryName(name)
         .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table(name)
    assert got.count() == logs.count() + 1 == got.select("log_id").distinct().count()


def test_ticket_totals_follow_moves_deletes_and_retries(spark):
    """Each batch, also delivered twice, leaves the sums of the rows that are there; a group without rows vanishes."""
    from tidemark.operators import tickets as T
    from tidemark.streaming.totals import TicketTotals
    as_of = dt.datetime(2024, 1, 30, 23, 59, 59)
    schema = ("op string, seq long, ticket_id long, agent_id long, status string, created_at timestamp_ntz, "
              "updated_at timestamp_ntz, closed_at timestamp_ntz")
    d, h = as_of.replace(hour=8, minute=0, second=0), dt.timedelta(hours=1)

    def row(op, seq, tid, agent, status, closed=None, updated=d + h, created=d):
        return (op, seq, tid, agent, status, created, updated, closed)
    batches = [
        [row("c", 1, 1, 7, "pending"), row("c", 1, 2, 7, "resolved"), row("c", 1, 3, 8, "in_progress"),
         row("c", 1, 4, None, "pending", created=None)],
        [row("u", 2, 1, 8, "resolved", d + 3 * h), row("d", 2, 3, 8, "in_progress"), row("c", 0, 2, 9, "pending")],  # moved, gone, stale
        [row("u", 3, 2, 7, "closed", d + 5 * h, updated=None), row("d", 3, 1, 8, "resolved")],
    ]
    chain = TicketTotals(spark, _tmp())
    agents = spark.createDataFrame([(k, f"a{k}", "x", "online") for k in (7, 8, 9)],
                                   "agent_id long, agent_name string, department string, status string")
    for b, rows in enumerate(batches):
        for _ in range(2):
            chain.process_batch(spark.createDataFrame(rows, schema), b)
        now = chain.ods.read()
        want = T.agent_workload(agents, now, as_of).drop("last_updated")
        assert sorted(map(tuple, chain.agent_workload(agents, as_of).collect())) == sorted(map(tuple, want.collect())), b
        got, want = chain.daily_stats(), T.daily_ticket_stats(now)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())), b
        board = T.ticket_dashboard(now, as_of).select("metric_name", "metric_value")
        assert sorted(map(tuple, chain.dashboard().collect())) == sorted(map(tuple, board.collect())), b


def test_order_and_product_totals_with_deletes(spark):
    from tidemark.operators import orders as O
    from tidemark.streaming.totals import OrderTotals, ProductTotals
    day = dt.date(2020, 1, 3)
    totals = OrderTotals(spark, _tmp())
    batches = [[_u(1, 1, "a"), _o(1, 1, 1, 10, "completed"), _o(2, 1, 1, 5, "pending")],
               [_o(1, 2, 1, 10, "completed", "d"), _o(2, 2, 1, 7, "completed", "u")],
               [_u(1, 2, "a", "d"), _o(2, 3, 1, 7, "completed", "d")]]
    want = [(1.0, 2.0, 10.0), (1.0, 1.0, 7.0), (0.0, 0.0, 0.0)]
    for b, rows in enumerate(batches):
        for _ in range(2):
            totals.process_batch(_envelope_rows(spark, rows), b)
        m = {r.metric_name: r.metric_value for r in totals.dashboard(day).collect()}
        assert (m["total_users"], m["total_orders"], m["total_sales"]) == want[b]
        assert sum(r.total_sales for r in totals.sales_trend().collect()) == want[b][2]
    assert totals.daily_stats().count() == 0
    at = dt.datetime(2020, 1, 1)
    schema = ("op string, seq long, order_id long, l_linenumber int, item_partkey long, item_suppkey long, created_at timestamp_ntz, "
              "product_name string, quantity int, unit_price decimal(10,2)")
    from decimal import Decimal

    def item(op, seq, order, line, product, q):
        return (op, seq, order, line, 1, 1, at, product, q, Decimal("2.50"))
    chain = ProductTotals(spark, _tmp())
    batches = [[item("c", 1, 1, 1, "p", 3), item("c", 1, 1, 2, "p", 4), item("c", 1, 2, 1, "p", 1), item("c", 1, 2, 2, "r", 9)],
               [item("d", 2, 1, 1, "p", 3), item("u", 2, 2, 1, "s", 5)],  # the order keeps a p line; a line changes its product
               [item("d", 3, 1, 2, "p", 4), item("u", 3, 2, 1, "r", 5)]]
    for b, rows in enumerate(batches):
        for _ in range(2):
            chain.process_batch(spark.createDataFrame(rows, schema), b)
        want = O.product_stats(O.item_facts(chain.ods.read()), day).drop("etl_time")
        got = chain.product_stats().select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), b


@pytest.mark.parametrize("n_batches", [1, 3])
def test_changes_without_a_time_reach_the_chain(spark, n_batches):
    root, at = _tmp(), [dt.datetime(2001, 1, 1 + i) for i in range(6)]
    rows = [(*_u(1, 1, "ann")[:-1], at[0]), (*_u(2, 2, "bob")[:-1], at[1])]
    rows += [(*_o(10 + i, 10 + i, 1, "10.00", "completed")[:-1], at[i]) for i in range(6)]
    rows += [(*_o(10, 30, 1, "10.00", "completed", "d")[:-1], None), (*_o(20, 31, 2, "7.00", "completed")[:-1], None)]
    CH.stage_change_files(_envelope_rows(spark, rows), f"{root}/changes", n_batches, 2)
    assert spark.read.parquet(f"{root}/changes").count() == len(rows)
    chain = OrdersChain(spark, f"{root}/tables", buckets=2, as_of=D)
    chain.run(f"{root}/changes", f"{root}/checkpoint", 2)
    assert {r.user_id: (r.total_orders, r.total_amount) for r in chain.user_stats().collect()} == {1: (5, 50.0), 2: (1, 7.0)}


def test_changes_without_any_time_are_one_range(spark):
    path = os.path.join(_tmp(), "changes")
    CH.stage_change_files(_envelope_rows(spark, [(*_u(i, i, "a")[:-1], None) for i in range(5)]), path, 3, 2)
    assert spark.read.parquet(path).count() == 5


def test_state_queries_keep_changes_without_a_time(spark):
    from types import SimpleNamespace

    from tidemark.plans import q_state as Q
    day = [dt.datetime(1999, 1, 1), dt.datetime(2024, 1, 12), dt.datetime(2024, 1, 25)]
    rows = [(1, "c", 1, "new", 1.0, day[0]), (2, "c", 1, "new", 1.0, day[1]), (3, "c", 1, "new", 1.0, day[2]),
            (4, "c", 1, "new", 1.0, None), (1, "u", 2, "done", 2.0, None), (2, "d", 2, "gone", 1.0, None)]
    changes = spark.createDataFrame(rows, "id long, op string, seq long, status string, value double, ts timestamp_ntz")
    c = SimpleNamespace(spark=spark, changes=changes)
    want = [(1, "done"), (3, "new"), (4, "new")]
    assert sorted((r.id, r.status) for r in Q.q_pk_table_latest(c).collect()) == want
    assert sorted((r.id, r.status) for r in Q.q_pk_table_restart(c).collect()) == want
    assert sorted((r.id, r.status) for r in Q.q_pk_table_as_of(c).collect()) == [(1, "new"), (2, "new")]


def test_user_stats_follow_from_the_dwd_orders(spark, monkeypatch):
    """the stage of the DWD orders is run by every batch, and the stats of the users are made of its rows."""
    made = O.dwd_orders
    monkeypatch.setattr(O, "dwd_orders", lambda *a: made(*a).where("order_id <> 11").withColumn(
        "order_amount", (F.col("order_amount") * 2).cast("decimal(12,2)")))
    chain = OrdersChain(spark, os.path.join(_tmp(), "chain"), buckets=2, as_of=D)
    chain.process_batch(_envelope_rows(spark, [_u(1, 1, "ann"), _o(10, 10, 1, "100.00", "completed"), _o(11, 11, 1, "50.00", "completed")]), 0)
    chain.process_batch(_envelope_rows(spark, [_o(12, 12, 1, "7.00", "completed"), _o(10, 20, 1, "30.00", "completed", "u")]), 1)
    assert [(r.total_orders, r.total_amount) for r in chain.user_stats().collect()] == [(2, 74.0)]
    written = chain.dwd_orders.table.log().select("batch_id", "order_id", "username", "email").collect()
    assert sorted(map(tuple, written)) == [(0, 10, "ann", "ann@x"), (1, 10, "ann", "ann@x"), (1, 12, "ann", "ann@x")]


@pytest.mark.parametrize("every,spread", [(None, 10_000), (2, 0)])
def test_dwd_orders_follow_orders_and_users(spark, monkeypatch, every, spread):
    """random changes, stale and redelivered ones too: the stored DWD rows are the orders joined with the users."""
    import random

    from tidemark.streaming import pktable
    monkeypatch.setattr(pktable, "SPREAD_ROWS", spread)
    rng = random.Random(5)
    chain = OrdersChain(spark, os.path.join(_tmp(), "c"), buckets=2, as_of=D, compact_every=every)

    def rows_of(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    def joined(orders, users):
        return rows_of(O.dwd_orders(orders, users, D).select(*DWD_COLS))
    for b in range(4):
        rows = [] if b == 1 else [_u(u, rng.randrange(3 * b + 2), rng.choice("abcz"), rng.choice("uuud")) for u in rng.sample(range(5), 3)]
        rows += [_o(i, rng.randrange(3 * b + 2), rng.choice([0, 1, 2, 3, 4, 9, None]), rng.choice(["1.50", "2.50"]),
                    rng.choice(["completed", "pending", None]), rng.choice("cuuud")) for i in rng.sample(range(12), 0 if b == 2 else 7)]
        for _ in range(2 if b == 2 else 1):  # a retried batch writes the same rows
            chain.process_batch(_envelope_rows(spark, rows), b)
        assert rows_of(chain.dwd_orders.read()) == joined(chain.ods_orders.read(), chain.ods_users.read()), b
    want = O.user_stats_left(O.dwd_users(chain.ods_users.read(), D), chain.dwd_orders.read(), D).select(*DWS_COLS)
    assert rows_of(chain.user_stats()) == rows_of(want)
    assert rows_of(chain.dwd_orders.as_of(1)) == joined(chain.ods_orders.as_of(1), chain.ods_users.as_of(1))
    assert chain.dwd_orders.table in chain.tables()


def test_orders_without_any_user_are_kept(spark):
    """orders that come before the first user have DWD rows without names, and get them when the user comes."""
    chain = OrdersChain(spark, os.path.join(_tmp(), "c"), buckets=2, as_of=D)
    chain.process_batch(_envelope_rows(spark, [_o(10, 10, 1, "3.00", "completed"), _o(11, 11, None, "5.00", "completed")]), 0)
    assert sorted((r.order_id, r.username) for r in chain.dwd_orders.read().collect()) == [(10, None), (11, None)]
    chain.process_batch(_envelope_rows(spark, [_u(1, 1, "ann")]), 1)
    assert sorted((r.order_id, r.username, r.email) for r in chain.dwd_orders.read().collect()) == [(10, "ann", "ann@x"), (11, None, None)]
    assert [(r.username, r.total_orders, r.total_amount) for r in chain.user_stats().collect()] == [("ann", 1, 3.0)]


def test_orders_of_a_hot_user_are_split(spark):
    """a user with half of a batch's orders is not one task's where the users are too many to be broadcast."""
    chain = OrdersChain(spark, os.path.join(_tmp(), "c"), buckets=2, as_of=D)
    at, key = F.lit(TS).cast("timestamp_ntz"), "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", key: "32k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    chain.ods_users.write_batch(spark.range(500).select(F.lit("c").alias("op"), F.lit(1).alias("seq"), "id", F.concat(F.lit("u"), "id").alias("username")), 0)
    chain.ods_orders.write_batch(spark.range(0, 60_000, 1, 4).select(
        F.lit("c").alias("op"), F.lit(1).alias("seq"), "id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 500).alias("user_id"),
        F.lit(1).alias("order_amount"), F.lit("pending").alias("order_status"), at.alias("created_at"), at.alias("updated_at")), 0, large=True)
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        chain.dwd_orders.apply(0, large=True)
        rows = chain.dwd_orders.rows(0, large=True)
        parts = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*rows.columns))).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r.n for r in parts) == 60_000 and max(r.n for r in parts) < 30_000
    got = chain.dwd_orders.read().where(F.col("username") == F.concat(F.lit("u"), "user_id"))
    assert got.count() == 60_000
