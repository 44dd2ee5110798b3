"""The daily equipment summary by signed deltas equals the batch job after every micro-batch."""

import datetime as dt
import os
import random
import tempfile

import pytest

from tidemark.operators import equipment as E
from tidemark.streaming.equipment_totals import EquipmentDays

T0 = dt.datetime(2024, 1, 10)
READING = ("tbl string, op string, seq long, monitoring_id long, equipment_id long, monitoring_time timestamp_ntz, voltage_a double, "
           "voltage_b double, voltage_c double, current_a double, current_b double, current_c double, power_active double, "
           "power_reactive double, frequency double, temperature double, humidity double")


def _r(i, seq, device, minute, volts=220.0, power=3.0, temp=50.0, op="c"):
    at = None if minute is None else T0 + dt.timedelta(minutes=minute)
    return ("reading", op, seq, i, device, at, volts, volts, volts, 1.5, 1.5, 1.5, power, 4.0, 50.0, temp, 1.0)


@pytest.fixture(scope="module")
def equipment(spark):
    return spark.createDataFrame([(7, "a", "t", 10.0), (8, "b", "t", 0.0)],
                                 "equipment_id long, equipment_name string, equipment_type string, capacity_mw double")


def _same(chain, equipment):
    got = chain.summary(equipment)
    want = E.equipment_daily_summary(E.reading_facts(chain.readings.read().drop("op", "seq")), equipment)
    assert got.columns == want.columns
    key = lambda r: (str(r["equipment_id"]), str(r["summary_date"]))
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for column in a.asDict():
            assert a[column] == (pytest.approx(b[column], abs=1e-9) if isinstance(b[column], float) else b[column]), (column, a, b)
    return got


class Kept(EquipmentDays):
    """Keeps the source readings too, so that the batch job can be run over them."""

    def __init__(self, spark, root, buckets=2):
        super().__init__(spark, root, buckets)
        from tidemark.streaming.pktable import PKTable
        self.source = PKTable(spark, f"{root}/source", ["monitoring_id"], buckets)

    def _process(self, batch, b):
        super()._process(batch, b)
        self.source.write_batch(batch.drop("tbl"), b)


def _follow(spark, equipment, batches, repeat=()):
    chain = Kept(spark, os.path.join(tempfile.mkdtemp(prefix="tidemark-test-"), "e"))
    out = []
    for b, rows in enumerate(batches):
        for _ in range(2 if b in repeat else 1):
            chain.process_batch(spark.createDataFrame(rows, READING), b)
        chain.readings, ods = chain.source, chain.readings
        out.append(_same(chain, equipment))
        chain.readings = ods
    return out


def test_extremes_hours_and_deviation_are_taken_back(spark, equipment):
    first, moved, gone = _follow(spark, equipment, [
        [_r(1, 1, 7, 10, 250.0), _r(2, 1, 7, 70, 210.0), _r(3, 1, 7, 75, 210.0, temp=None), _r(4, 1, 8, 0), _r(5, 1, None, 0, power=None)],
        [_r(1, 2, 7, 10 + 1440, 250.0, op="u"), _r(2, 0, 7, 0, 999.0, op="u"), _r(6, 1, 7, -30, 230.0)],  # to another day; stale; late
        [_r(6, 2, 7, -30, op="d"), _r(4, 2, 8, 0, op="d"), _r(3, 2, 7, 75, 211.5, temp=70.0, op="u")]], repeat=(1,))
    day = {(r["equipment_id"], r["summary_date"]): r for r in first}
    assert day[7, T0.date()]["voltage_max"] == 250.0 and day[7, T0.date()]["uptime_hours"] == 2
    day = {(r["equipment_id"], r["summary_date"]): r for r in moved}
    assert day[7, T0.date()]["voltage_max"] == 210.0 and day[7, T0.date()]["uptime_hours"] == 1
    assert day[7, T0.date()]["voltage_std"] == 0.0 and len(moved) == 5
    assert len(gone) == 3 and not [r for r in gone if r["equipment_id"] == 8]


def test_random_changes_of_a_hot_device(spark, equipment):
    rng, seq = random.Random(9), 0
    batches = []
    for _ in range(4):
        rows = []
        for i in rng.sample(range(60), 30):
            seq += 1
            rows.append(_r(i, seq, rng.choice([7, 7, 7, 8]), rng.randrange(3 * 1440), rng.choice([195.0, 220.0, 220.01, 245.5]),
                           rng.choice([1.25, 2.5, None]), rng.choice([10.0, 60.0, None]), rng.choice("cuud")))
        batches.append(rows)
    assert len(_follow(spark, equipment, batches, repeat=(2,))[-1]) >= 4
