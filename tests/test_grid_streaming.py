"""Grid and alarm streams: late, corrected, withdrawn and repeated changes, null keys, the state that is read."""

import datetime as dt
import os
import random
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.operators import grid as G
from tidemark.operators import scenarios as S
from tidemark.sources import changes as CH
from tidemark.streaming.grid_totals import AlarmTotals, GridTotals
from tidemark.streaming.incremental import OrdersChain
from tidemark.streaming.totals import ProductTotals, SignedSums

T0 = dt.datetime(2024, 1, 10, 8, 0, 0)
D = dt.date(2001, 8, 1)


def _tmp():
    return tempfile.mkdtemp(prefix="tidemark-test-")


DISPATCH = ("tbl string, op string, seq long, dispatch_id long, grid_region string, dispatch_time timestamp_ntz, load_demand_mw double, "
            "supply_capacity_mw double, emergency_level string, load_balance_status string, grid_frequency_hz double, "
            "voltage_stability double, device_id long, device_name string, device_type string, location string, capacity_mw double, "
            "installation_date timestamp_ntz, efficiency_rate double, maintenance_status string, real_time_voltage double, "
            "real_time_current double, real_time_temperature double")


def _d(i, seq, region, hour, op="c", demand=100.0, level="HIGH", volt=650.0):
    return ("dispatch", op, seq, i, region, T0 + dt.timedelta(hours=hour), demand, 110.0, level, "OK", 50.0, volt) + (None,) * 11


def _v(i, seq, place, op="c", temp=60.0, volt=235.0, eff=0.9):
    return ("device", op, seq) + (None,) * 9 + (i, f"d{i}", "t", place, 5.0, T0, eff, "NORMAL", volt, 50.0, temp)


def test_grid_summary_follows_both_sides(spark):
    chain = GridTotals(spark, os.path.join(_tmp(), "g"), buckets=2)
    batches = [
        [_v(1, 1, "ASIA"), _v(2, 1, "ASIA", temp=90.0), _v(3, 1, "EUROPE"), _d(1, 1, "ASIA", 0)],
        [_d(2, 1, "ASIA", 1, level="CRITICAL"), _d(3, 1, "EUROPE", 0), _d(1, 2, "ASIA", 1, "u"), _v(2, 2, "ASIA", "u", volt=200.0)],
        [_d(1, 1, "AFRICA", 5)],                                    # stale: nothing changes
        [_v(3, 2, "ASIA", "u"), _d(2, 2, "ASIA", 1, "d"), _d(4, 1, None, 0)],
        [_v(1, 9, "ASIA", "d"), _v(2, 9, "ASIA", "d"), _v(3, 9, "ASIA", "d")],  # a region without devices
        [_v(7, 1, "ASIA"), _v(8, 1, "AFRICA"), _d(9, 1, "AFRICA", 2)]]
    for b, rows in enumerate(batches):
        for _ in range(2 if b == 1 else 1):  # a batch delivered twice
            chain.process_batch(spark.createDataFrame(rows, DISPATCH), b)
        d, v = G.conform_dispatch(chain.dispatches.read()), G.conform_device(chain.devices.read())
        want = sorted(map(tuple, G.smart_grid_summary(d, v).collect()))
        assert sorted(map(tuple, chain.summary().collect())) == want, b
    assert len(want) == 2


EVENTS = ("tbl string, op string, seq long, alarm_id long, equipment_id long, alarm_level int, occurred_at timestamp_ntz, "
          "monitoring_id long, monitoring_time timestamp_ntz, voltage_a double, voltage_b double, voltage_c double, current_a double, "
          "current_b double, current_c double, power_active double, power_reactive double, frequency double, temperature double, "
          "humidity double")


def _a(i, seq, e, minute, level=5, op="c"):
    at = None if minute is None else T0 + dt.timedelta(minutes=minute)
    return ("alarm", op, seq, i, e, level, at) + (None,) * 13


def _r(i, seq, e, minute, temp=80.0, p=3.0, op="c"):
    at = None if minute is None else T0 + dt.timedelta(minutes=minute)
    return ("reading", op, seq, None, e, None, None, i, at, 220.0, 220.0, 220.0, 1.0, 1.0, 1.0, p, 4.0, 50.0, temp, 1.0)


def test_alarm_report_without_watermark(spark):
    equipment = spark.createDataFrame([(7, "X"), (8, "Y"), (9, "X")], "equipment_id long, location string")
    as_of = dt.datetime(2024, 1, 30)
    chain = AlarmTotals(spark, os.path.join(_tmp(), "a"), buckets=2)
    batches = [
        [_r(1, 1, 7, 0), _r(2, 1, 7, 70), _a(1, 1, 7, 5), _a(2, 1, 8, 5, 1)],
        [_a(3, 1, 7, 62, 2), _r(3, 1, 8, -5, p=None), _r(4, 1, None, 5), _a(9, 1, None, 5), _a(10, 1, 9, None)],
        [_r(5, 1, 7, 9), _r(6, 1, 7, -5)],                            # days late, still counted
        [_r(1, 2, 7, 300, op="u"), _a(3, 2, 7, 70, 4, op="u")],       # both sides move
        [_r(2, 2, 7, 70, op="d"), _a(1, 2, 7, 5, op="d"), _r(5, 0, 7, 9, temp=1.0, op="u")]]
    rng = random.Random(4)
    batches.append([_r(100 + i, 1, rng.choice([7, 8, 9]), rng.randrange(200), rng.choice([60.0, 90.0])) for i in range(40)] + [
        _a(100 + i, 1, rng.choice([7, 8, 9]), rng.randrange(200), rng.randrange(1, 6)) for i in range(20)])
    for b, rows in enumerate(batches):
        for _ in range(2 if b == 3 else 1):
            chain.process_batch(spark.createDataFrame(rows, EVENTS), b)
        alarms, readings = chain.alarms.read(), chain.readings.read()
        want = S.alarm_status_join(alarms.drop("op", "seq"), readings.drop("op", "seq"), equipment, as_of)
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, chain.report(equipment, as_of).collect()), key=key) == sorted(map(tuple, want.collect()), key=key), b
    assert len(want.collect()) >= 2


def _order(i, seq, user, amount, status, day, op="c"):
    at = dt.datetime(2001, 1, 1) + dt.timedelta(days=day // 3, hours=day % 3)
    return ("orders", op, seq, i, user, None, None, Decimal(amount), status, at, at, at)


def _user(i, seq, name):
    return ("users", "c", seq, i, None, name, "m", None, None, T0, T0, T0)


def test_newest_order_is_retracted(spark):
    """Random moves, status changes and deletes: the sums and the newest completed order equal the batch job's."""
    from tidemark.operators import orders as O
    chain = OrdersChain(spark, os.path.join(_tmp(), "c"), buckets=2, as_of=D)
    rng = random.Random(11)
    for b in range(4):
        rows = [_user(u, b, f"u{u}") for u in range(4)] if b != 1 else []
        for i in {rng.randrange(14) for _ in range(12)}:
            rows.append(_order(i, b * 10 + 1, rng.choice([0, 1, 1, 2, None]), "1.50", rng.choice(["completed", "completed", "pending", None]),
                               rng.randrange(12), rng.choice("uuud")))
        chain.process_batch(spark.createDataFrame(rows, CH.ENVELOPE), b)
        want = O.user_stats_left(O.dwd_users(chain.ods_users.read(), D), O.order_facts(chain.ods_orders.read()), D).drop("update_time")
        got = chain.user_stats().select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), b


def test_hot_user_is_not_read_again(spark):
    """A change to a user with many orders touches stored rows of that change only, not the user's orders."""
    chain = OrdersChain(spark, os.path.join(_tmp(), "h"), buckets=2, as_of=D)
    many = [_user(1, 0, "hot")] + [_order(i, 1, 1, "1.00", "completed", i % 90) for i in range(900)]
    chain.process_batch(spark.createDataFrame(many, CH.ENVELOPE), 0)
    chain.process_batch(spark.createDataFrame([_order(5, 2, 1, "1.00", "pending", 5, "u")], CH.ENVELOPE), 1)
    counts = chain.dws_users.counts.table
    assert counts.log(0).where("batch_id = 1").count() == 3  # the user, one day, one instant
    # what a lookup of the newest order may read: the user's days and one day's instants
    assert counts.as_of(1).where("day IS NULL").count() <= 31 and counts.as_of(1).where("day IS NOT NULL").count() <= 90
    assert [(r.total_orders, r.total_amount) for r in chain.user_stats().collect()] == [(899, 899.0)]


def test_null_keys_are_summed(spark):
    sums = SignedSums(spark, os.path.join(_tmp(), "s"), ["k"], {"q": "bigint"}, 2)
    rows = spark.createDataFrame([(None, 1, 7), ("a", 1, 1)], "k string, n int, q int")
    for b in range(2):
        sums.apply(rows, rows.limit(0), b).unpersist()
    assert sorted((r.k or "", r.n, r.q) for r in sums.read().collect()) == [("", 2, 14), ("a", 2, 2)]
    sums.apply(rows.limit(0), rows.unionByName(rows), 2).unpersist()
    assert sums.read().count() == 0
    chain = ProductTotals(spark, os.path.join(_tmp(), "p"), 2)
    schema = ("op string, seq long, order_id long, l_linenumber int, item_partkey long, item_suppkey long, created_at timestamp_ntz, "
              "product_name string, quantity int, unit_price decimal(10,2)")
    for b in range(2):
        chain.process_batch(spark.createDataFrame([("c", 1, b, 1, 1, 1, T0, None, 3, Decimal("2.00"))], schema), b)
    assert [(r.product_name, r.total_quantity, r.total_orders) for r in chain.product_stats().collect()] == [(None, 6, 2)]
    assert chain.products.read().where(F.col("product_name").isNull()).count() == 1
