"""What the streamed chains cost on large change logs: files of a range, sums by plain aggregates, large batches."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.sources import changes as CH
from tidemark.sources.tables import Tables
from tidemark.streaming import pktable
from tidemark.streaming.totals import ProductTotals, SignedSums, changed_rows, signed_rows

T0 = dt.datetime(2001, 1, 1)


def _tmp():
    return tempfile.mkdtemp(prefix="tidemark-t-")


def test_a_large_range_is_more_files(spark, monkeypatch):
    """F2: the files of a range follow its rows; one range is still one micro-batch, and no row is lost."""
    monkeypatch.setattr(CH, "ROWS_PER_FILE", 20, raising=False)
    rows = spark.range(300).select("id", F.lit(1).alias("seq"), F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit(T0)).alias("event_time"))
    root, seen = _tmp(), []
    files = CH.stage_change_files(rows, f"{root}/changes", 3, 2)
    assert files == 5
    (CH.read_change_stream(spark, f"{root}/changes", rows.schema, files).writeStream
     .foreachBatch(lambda b, i: seen.append({r.id for r in b.collect()}))
     .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    assert len(seen) == 3 and set.union(*seen) == set(range(300)) and max(seen[0]) < min(seen[1]) and max(seen[1]) < min(seen[2])


def test_sums_are_plain_aggregates(spark):
    """stored sums are added up by a hash aggregate, from the log alone and from a snapshot and the log after it."""
    sums = SignedSums(spark, os.path.join(_tmp(), "s"), ["k"], {"q": "bigint"}, 2)
    rows = spark.createDataFrame([("a", 1, 7), ("b", 1, 1)], "k string, n int, q int")
    none = rows.limit(0)
    for b in range(2):
        sums.apply(rows, none, b)
    assert "SortAggregate" not in sums.read()._jdf.queryExecution().toString()
    sums.table.compact(1)
    touched = sums.apply(none, rows.where("k = 'b'"), 2)
    assert [(r.k, r.n_before, r.n, r.d_q) for r in touched.collect()] == [("b", 2, 1, -1)]
    sums.apply(none, rows.where("k = 'b'"), 3)
    assert [(r.k, r.n, r.q) for r in sums.read().collect()] == [("a", 2, 14)]
    sums.table.compact(3)
    sums.apply(rows, none, 4)
    assert sorted((r.k, r.n, r.q) for r in sums.read().collect()) == [("a", 3, 21), ("b", 1, 1)]


def test_large_batches_read_all_buckets(spark, monkeypatch):
    """a batch taken to touch every bucket gives the same sums, retried or not."""
    monkeypatch.setattr(pktable, "SPREAD_ROWS", 0, raising=False)
    schema = ("op string, seq long, order_id long, l_linenumber int, item_partkey long, item_suppkey long, created_at timestamp_ntz, "
              "product_name string, quantity int, unit_price decimal(10,2)")
    chain = ProductTotals(spark, os.path.join(_tmp(), "p"), 2)
    batches = [[("c", 1, i, 1, i, 1, T0, f"p{i % 2}", 2, Decimal("3.00")) for i in range(6)],
               [("u", 2, 0, 1, 0, 1, T0, "p1", 5, Decimal("3.00")), ("d", 2, 1, 1, 1, 1, T0, "p1", 2, Decimal("3.00"))]]
    for b, rows in enumerate(batches):
        for _ in range(2):
            chain.process_batch(spark.createDataFrame(rows, schema), b)
    assert chain.ods.is_spread(1)
    assert sorted(map(tuple, chain.product_stats().collect())) == [("p0", 4, 12.0, 2, 3.0), ("p1", 9, 27.0, 3, 3.0)]


def test_status_takes_rows_one_by_one():
    """the newest of a key's rows is found row by row, with one read and one write of its state."""
    from types import SimpleNamespace

    from pyspark.sql import Row
    from tidemark.streaming.live_status import VALUES, ConnectionStatus
    calls = []
    job = ConnectionStatus(600_000)
    job.newest = SimpleNamespace(get=lambda: calls.append("get"), update=lambda s: calls.append(s))
    reading = Row("equipment_id", "monitoring_us", "monitoring_id", *VALUES)
    rows = [reading(7, us, no, float(no), *[None] * (len(VALUES) - 1)) for us, no in ((5, 1), (9, 2), (9, 3), (1, 4))]
    out = list(job.handleInputRows((7,), iter(rows), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 10**13)))
    assert [(r.equipment_id, r.monitoring_us, r.monitoring_id, r.voltage_avg, r.connection_status, r.version) for r in out] == [
        (7, 9, 3, 3.0, "OFFLINE", 1)]
    assert calls[0] == "get" and len(calls) == 2


def test_a_range_is_landed_by_one_job(spark, monkeypatch):
    """one job deals a change log to the files of all ranges; rows without a time land last, none is lost."""
    monkeypatch.setattr(CH, "ROWS_PER_FILE", 20, raising=False)
    at = F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit(T0))
    rows = spark.range(200).select("id", F.lit(1).alias("seq"), F.when(F.col("id") % 10 > 0, at).alias("event_time"))
    root, jobs = _tmp(), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("landing", "files of the ranges")
    try:
        files = CH.stage_change_files(rows, f"{root}/changes", 4, 2)
        assert len(jobs.getJobIdsForGroup("landing")) <= 5
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    landed = spark.read.schema(rows.schema).parquet(f"{root}/changes").select(
        "*", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("m")).collect()
    assert sorted(r.id for r in landed) == list(range(200)) and len({r.f for r in landed}) == 4 * files
    dated = sorted({r.m for r in landed})
    ends = [max(r.id for r in landed if r.m == m and r.id % 10) for m in dated]
    assert len(dated) == 4 and ends == sorted(ends) and all(r.m == dated[-1] for r in landed if r.event_time is None)


def test_versions_read_their_source_once(spark, sf_small):
    """the versions of an item or ticket come from one scan and one join, not one for each."""
    t = Tables(spark, sf_small)
    for log, table in ((CH.item_change_log(t), "lineitem"), (CH.ticket_change_log(t), "events")):
        plan = log._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == (2 if table == "lineitem" else 1)
        assert log.count() == 2 * t.read(table).count()


def test_a_large_batch_is_written_where_it_is(spark, monkeypatch):
    """a large batch is not shuffled to be written; it reads and retries as any other."""
    monkeypatch.setattr(pktable, "SPREAD_ROWS", 10, raising=False)
    t = pktable.PKTable(spark, os.path.join(_tmp(), "t"), ["id"], 2)
    rows = spark.range(0, 100, 1, 3).select(F.lit("c").alias("op"), F.lit(1).alias("seq"), "id")
    assert t.is_large(rows) and not t.is_large(rows.limit(19))
    for _ in range(2):
        t.write_batch(rows, 0, large=True)
    assert not t.is_stored(-1) and t.is_stored(0)
    names = t.log().select(F.col("bucket"), F.input_file_name().alias("f")).distinct()
    assert names.where("bucket = 0").count() == 3 and t.read().count() == 100


def test_items_are_dealt_before_their_versions_are_made(spark, sf_small):
    """the files of the ranges get every item by one shuffle of its row, and the bounds need no join."""
    t = Tables(spark, sf_small)
    items = CH.item_versions(t)
    plan = items.log(4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("RepartitionByExpression")
    assert "Join" not in items.times()._jdf.queryExecution().optimizedPlan().toString()
    root = _tmp()
    CH.stage_change_files(items, f"{root}/changes", 3, 2)
    landed, log = spark.read.schema(items.schema).parquet(f"{root}/changes"), CH.item_change_log(t)
    assert landed.columns == log.columns and landed.exceptAll(log).isEmpty() and log.exceptAll(landed).isEmpty()


def test_stored_rows_of_other_times_are_left_out(spark):
    """stored rows whose key has a time that no key of the batch can have are not dealt again; null times may match."""
    t = pktable.PKTable(spark, os.path.join(_tmp(), "t"), ["id", "at"], 2)
    schema = "op string, seq long, id long, at timestamp_ntz, v int"
    days = [T0 + dt.timedelta(days=d) for d in range(10)]
    t.write_batch(spark.createDataFrame([("c", 1, i, d, 1) for i, d in enumerate(days)] + [("c", 1, 99, None, 1)], schema), 0)
    t.write_batch(spark.createDataFrame([("u", 2, 8, days[8], 2), ("d", 2, 9, days[9], 2), ("u", 2, 99, None, 2), ("c", 1, 7, days[8], 5)], schema), 1)
    assert sorted(r.id for r in t.changes_with(1).where("NOT _new").collect()) == [8, 9, 99]
    got = {(r.id, r.before and r.before.v, r.after and r.after.v) for r in changed_rows(t, 1, ["id"]).collect()}
    assert got == {(8, 1, 2), (9, 1, None), (99, 1, 2), (7, None, 5)}


def test_pairs_keep_counts_and_products_exact_money(spark, monkeypatch):
    """a pair's rows meet in one shuffle, it keeps its number of items; money stays exact beyond the range of long."""
    monkeypatch.setattr(pktable, "SPREAD_ROWS", 0)
    schema = ("op string, seq long, order_id long, l_linenumber int, item_partkey long, item_suppkey long, created_at timestamp_ntz, "
              "product_name string, quantity int, unit_price decimal(10,2)")
    chain = ProductTotals(spark, os.path.join(_tmp(), "p"), 2)
    most, q = Decimal("99999999.99"), 90_000_000
    rows = [("c", 1, 1, i, 1, 1, T0, "p", q, most) for i in range(12)] + [("c", 1, 2, 1, 1, 1, T0, "p", None, Decimal("0.01")), ("c", 1, 3, 1, 1, 1, T0, "p", -3, Decimal("0.07"))]
    chain.process_batch(spark.createDataFrame(rows, schema), 0)
    chain.process_batch(spark.createDataFrame([("d", 2, 1, 0, 1, 1, T0, "p", q, most), ("d", 2, 2, 1, 1, 1, T0, "p", None, None)], schema), 1)
    one, = chain.products.read().collect()
    assert (one.n, one.orders, one.quantity, one.sales, one.price, one.n_price) == (
        12, 2, 11 * q - 3, 11 * q * most - Decimal("0.21"), 11 * most + Decimal("0.07"), 12)
    assert sorted(chain.pairs.read().columns) == ["n", "order_id", "product_name"]
    signed = chain.pairs.signed(chain._pair_rows(signed_rows(changed_rows(chain.ods, 0, ["order_id"]), ["order_id"])), F.col("sign"))
    plan = signed.groupBy("product_name", "order_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_numbers_of_changes_are_written_plainly(spark):
    """no dictionaries of numbers and times in files of changes, which cost a third of their writing."""
    pq = pytest.importorskip("pyarrow.parquet")
    t = pktable.PKTable(spark, os.path.join(_tmp(), "t"), ["id"], 2)
    t.write_batch(spark.range(100).select(F.lit("c").alias("op"), F.lit(1).alias("seq"), "id", (F.col("id") % 3).alias("v")), 0)
    meta = pq.ParquetFile(next(p for p in t.log().inputFiles()).removeprefix("file://")).metadata.row_group(0)
    told = {meta.column(i).path_in_schema: any("DICTIONARY" in e for e in meta.column(i).encodings) for i in range(meta.num_columns)}
    assert told == {"op": True, "seq": False, "id": False, "v": False}


def test_orders_meet_their_lines_once(spark, sf_small):
    """the rows of the chain are made once, for the bounds and both versions of an order; the log is the same."""
    t = Tables(spark, sf_small)
    chain = CH.chain_versions(t)
    plan = chain.log(4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.index("Generate explode") < plan.index("RepartitionByExpression")
    root = _tmp()
    held = chain.settled(f"{root}/rows")
    for df in (held.log(), held.times()):
        assert "Join " not in df._jdf.queryExecution().optimizedPlan().toString()
    CH.stage_change_files(chain, f"{root}/changes", 2, 2)
    landed, log = spark.read.schema(CH.ENVELOPE).parquet(f"{root}/changes"), CH.chain_change_log(t)
    assert chain.schema.names == CH.ENVELOPE.names and log.count() == t.customer.count() + 2 * t.orders.count()
    assert landed.exceptAll(log).isEmpty() and log.exceptAll(landed).isEmpty()
    ends = log.where("tbl = 'orders' AND seq % 2 = 1").select("id", "op", "order_status", "event_time", "updated_at")
    want = spark.sql("""SELECT o_orderkey, IF(o_orderstatus IN ('F', 'O'), 'u', 'd'), CASE o_orderstatus WHEN 'F' THEN 'completed'
        WHEN 'O' THEN 'pending' ELSE 'cancelled' END, coalesce(s, o_orderdate), coalesce(s, o_orderdate) FROM {o}
        LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS s FROM {l} GROUP BY l_orderkey) ON l_orderkey = o_orderkey""", o=t.orders, l=t.lineitem)
    assert sorted(map(tuple, ends.collect())) == sorted(map(tuple, want.collect()))


def test_files_of_folders_are_not_sorted_first(spark):
    """a task that writes to few folders sorts no rows by folder; the setting is back afterwards."""
    from tidemark.session import open_files
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    t = pktable.PKTable(spark, os.path.join(_tmp(), "t"), ["id"], 3)
    seen, write = [], pktable.change_file_options
    rows = spark.range(90).select(F.lit("c").alias("op"), F.lit(1).alias("seq"), "id")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pktable, "change_file_options", lambda r: seen.append(spark.conf.get(key, None)) or write(r))
        t.write_batch(rows, 0, large=True)
    assert seen == ["8"] and spark.conf.get(key, None) == before and t.read().count() == 90
    with pytest.raises(ZeroDivisionError), open_files(spark):
        1 / 0
    assert spark.conf.get(key, None) == before


def test_a_batch_without_rows_leaves_no_log(spark):
    """the users of a batch are written without a look at all its rows first; without any there is no log batch."""
    t = pktable.PKTable(spark, os.path.join(_tmp(), "t"), ["id"], 2)
    rows = spark.range(5).select(F.lit("c").alias("op"), F.lit(1).alias("seq"), "id")
    t.write_batch(rows, 0, empty=False)
    t.write_batch(rows.where("id > 9"), 1, empty=False)
    assert t.is_stored(0) and t.log(0) is None and t.read().count() == 5


def test_users_move_by_what_changed(spark, sf_small):
    """an order that stays as it was gives no signed row, a completed one one of sums; sums are plain exact numbers."""
    from tidemark.streaming.incremental import UserTops
    tops = UserTops(spark, _tmp(), 2)
    side = "struct<user_id:bigint,order_amount:decimal(12,2),order_status:string,created_at:timestamp_ntz>"
    most, day = Decimal("9999999999.99"), 11323

    def rows(before, after):
        changed = spark.createDataFrame([(1, before, after)], f"id bigint, before {side}, after {side}")
        return sorted([(r.user_id, r.day is None, r.slot is None, r.n, r.kept, None if r.high is None else r.high * 2**20 + r.low, r.n_amount)
                       for r in tops._signed(changed).collect()], key=str)
    opened, done = (7, most, "pending", T0), (7, most, "completed", T0)
    cents = int(most * 100)
    assert rows(opened, opened) == [] == rows(done, done) == rows((None, most, "completed", T0), None)
    assert rows(opened, done) == [(7, False, False, 1, None, None, None), (7, True, False, 1, None, None, None), (7, True, True, 0, 1, cents, 1)]
    assert rows(done, None) == [(7, False, False, -1, None, None, None), (7, True, False, -1, None, None, None), (7, True, True, -1, -1, -cents, -1)]
    assert rows(done, (8, None, None, None)) == [(7, False, False, -1, None, None, None), (7, True, False, -1, None, None, None),
                                                 (7, True, True, -1, -1, -cents, -1), (8, True, True, 1, 1, 0, 0)]
    frame = spark.createDataFrame([(i, None, (1, most if i else None, "completed", T0)) for i in range(3)], f"id bigint, before {side}, after {side}")
    tops.apply(frame, 0)
    assert "SortAggregate" not in tops.read()._jdf.queryExecution().executedPlan().toString()
    one, = tops.read().collect()
    assert (one.n, one.kept, one.amount, one.n_amount, one.top) == (3, 3, 2 * most, 2, day * 86_400_000_000)


def test_order_amounts_are_those_of_the_cast(spark):
    """amounts taken from whole cents are those of the cast, also between cents, out of range, negative or missing."""
    from tidemark.sources import bind
    xs = [0.0, -0.0, 1.005, 2.675, 0.005, -0.005, 0.1 + 0.2, 33.335, -75462.67, 999999999.99, 1e9, 1234567890.12, 1e-9, None]
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    got = frame.select(bind._money(F.col("x")).alias("got"), F.col("x").cast("decimal(12,2)").alias("want"))
    assert dict(got.dtypes)["got"] == "decimal(12,2)" and all(r.got == r.want for r in got.collect())
