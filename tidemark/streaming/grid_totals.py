"""Grid and equipment reports that follow their change streams by signed deltas.

``GridTotals``: dispatches and devices -> sums of either side and of their
pairs per region and hour. What a pair contributes is bilinear in the two sides,
so with a batch that changes side A by dA and side B by dB the pairs change by
dA x B (B as before the batch) plus A x dB (A as after it): only region-hours
with new dispatches, and those of a region with changed devices, are touched,
and no pair is ever formed.

``AlarmTotals``: alarms and readings of a device within some minutes of each
other. Both sides are kept, by device and time slot, without a watermark: a
late or corrected reading finds the alarms around it and corrects their sums,
a late or changed alarm finds the readings around it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import equipment as E
from tidemark.operators import grid as G
from tidemark.operators import scenarios as S
from tidemark.streaming.pktable import PKTable
from tidemark.streaming.totals import SignedSums, _Totals

_EXACT = "decimal(38,18)"
_DISPATCH = ["dispatch_id", "grid_region", "dispatch_time", "load_demand_mw", "supply_capacity_mw", "emergency_level",
             "load_balance_status", "grid_frequency_hz", "voltage_stability"]
_DEVICE = ["device_id", "device_name", "device_type", "location", "capacity_mw", "installation_date", "efficiency_rate",
           "maintenance_status", "real_time_voltage", "real_time_current", "real_time_temperature"]


def _types(measures: list[str], count: str) -> dict[str, str]:
    return {m: _EXACT if m.startswith("s_") else "bigint" for m in measures if m != count}


class GridTotals(_Totals):
    """Dispatch and device stream -> region-hour summary."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 4):
        self.dispatches = PKTable(spark, f"{root}/ods_dispatch", ["dispatch_id"], buckets)
        self.devices = PKTable(spark, f"{root}/ods_device", ["device_id"], buckets)
        hour = ["_p", "grid_region", "time_window"]
        self.by_hour = SignedSums(spark, f"{root}/by_hour", hour, _types(G.DISPATCH_MEASURES, "nd"), buckets, bucket_keys=["_p"])
        self.by_region = SignedSums(spark, f"{root}/by_region", ["_p"], _types(G.DEVICE_MEASURES, "nv"), buckets)
        self.pairs = SignedSums(spark, f"{root}/pairs", hour, {"good_voltage": "bigint", "high_risk": "bigint"}, buckets)

    def _process(self, batch: DataFrame, b: int) -> None:
        held = []

        def side(tbl, ods, columns, conform, measures, count, sums):
            """The batch's rows of one source through its sums; the keys touched, None without changes."""
            rows = batch.where(F.col("tbl") == tbl).select("op", "seq", *columns)
            if rows.isEmpty():  # one column of the batch
                return None
            before, after, changed = self._change(ods, rows, b)
            before, after = (measures(conform(x)).withColumnRenamed(count, "n") for x in (before, after))
            touched = sums.apply(after, before, b)
            held.extend([changed, touched])
            return touched
        d = side("dispatch", self.dispatches, _DISPATCH, G.conform_dispatch, G.dispatch_measures, "nd", self.by_hour)
        v = side("device", self.devices, _DEVICE, G.conform_device, G.device_measures, "nv", self.by_region)
        parts = []
        if d is not None:
            region = self._as_of(self.by_region, b - 1, d)
            if region is not None:
                parts.append(self._products(d, "d_", region, ""))
        if v is not None:
            hours = self._as_of(self.by_hour, b, v)
            if hours is not None:
                parts.append(self._products(hours, "", v, "d_"))
        if parts:
            signed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            held.append(self.pairs.add(signed, b))
        for df in held:
            df.unpersist()

    @staticmethod
    def _as_of(sums: SignedSums, version: int, only: DataFrame) -> DataFrame | None:
        """The sums of the region prefixes of ``only``; None before the first write."""
        try:
            return sums.table.as_of(version, only.select("_p"))
        except FileNotFoundError:
            return None

    def _products(self, hours: DataFrame, d: str, regions: DataFrame, v: str) -> DataFrame:
        """What the pairs change by: one side's sums times the other's differences, or the reverse."""
        a = hours.select(*self.by_hour.keys, *[F.col(f"{d}{'n' if m == 'nd' else m}").alias(m) for m in G.DISPATCH_MEASURES])
        w = regions.select(F.col("_p").alias("_q"), *[F.col(f"{v}{'n' if m == 'nv' else m}").alias(m) for m in G.DEVICE_MEASURES])
        j = a.join(w, F.col("_p").eqNullSafe(F.col("_q")))
        p = G.pair_sums(F.col)
        return j.select(*self.pairs.keys, p["pairs"].alias("n"), p["good_voltage"].alias("good_voltage"),
                        p["high_risk"].alias("high_risk"))

    def summary(self) -> DataFrame:
        """The columns of ``grid.smart_grid_summary``: region-hours joined with their region's row, no source is read."""
        keys = self.by_hour.keys
        regions = self.by_region.read().withColumnRenamed("n", "nv")
        pairs = self.pairs.read().withColumnRenamed("n", "pairs")
        j = self.by_hour.read().withColumnRenamed("n", "nd").join(F.broadcast(regions), "_p").join(pairs, keys)
        doubles = [m for m in (*G.DISPATCH_MEASURES, *G.DEVICE_MEASURES) if m.startswith("s_")]
        return G.summary_of(j.withColumns({m: F.col(m).cast("double") for m in doubles}), places=10)


class AlarmTotals(_Totals):
    """Alarm and reading stream -> per device and day: alarms, critical alarms, sums over the readings around them."""

    SUMS = {"critical": "bigint", "pf_sum": "decimal(28,4)", "pf_n": "bigint", "hot": "bigint"}
    ALARM = ["alarm_id", "equipment_id", "alarm_level", "occurred_at"]
    READING = ["monitoring_id", "equipment_id", "monitoring_time", "temperature", "power_factor"]
    SLOT = 3600  # seconds of a time slot; a window touches few of them

    def __init__(self, spark: SparkSession, root: str, buckets: int = 4, minutes: int = 10):
        self.minutes = minutes
        self.alarms = PKTable(spark, f"{root}/ods_alarms", ["alarm_id"], buckets)
        self.readings = PKTable(spark, f"{root}/ods_readings", ["monitoring_id"], buckets)
        # the same rows by device and slot: the other side's lookups read the slots around a change
        place = ["equipment_id", "slot"]
        self.alarms_at = PKTable(spark, f"{root}/alarms_at", [*place, "alarm_id"], buckets, bucket_keys=place)
        self.readings_at = PKTable(spark, f"{root}/readings_at", [*place, "monitoring_id"], buckets, bucket_keys=place)
        self.by_day = SignedSums(spark, f"{root}/by_day", ["equipment_id", "day"], self.SUMS, buckets)

    def _slot(self, ts) -> F.Column:
        return F.floor(F.unix_micros(F.to_timestamp(ts)) / F.lit(self.SLOT * 1_000_000)).cast("bigint")

    def _around(self, rows: DataFrame, ts: str) -> DataFrame:
        """Device and slots that the windows around ``rows`` touch."""
        lo, hi = (self._slot(F.timestamp_add("MINUTE", F.lit(m), F.col(ts))) for m in (-self.minutes, self.minutes))
        return rows.where(F.col(ts).isNotNull()).select("equipment_id", F.explode(F.sequence(lo, hi)).alias("slot"))

    @staticmethod
    def _at(table: PKTable, version: int, only: DataFrame, like: DataFrame) -> DataFrame:
        try:
            return table.as_of(version, only).select(*like.columns)
        except FileNotFoundError:
            return like.limit(0)

    def _index(self, table: PKTable, before: DataFrame, after: DataFrame, ts: str, b: int) -> None:
        """Bring the rows by device and slot up to date; a row that moved leaves its old slot."""
        rows = after.withColumn("slot", self._slot(F.col(ts))).withColumn("op", F.lit("u"))
        old = before.withColumn("slot", self._slot(F.col(ts))).select(*table.keys).join(
            rows.select(*table.keys).withColumnsRenamed({k: f"_{k}" for k in table.keys}),
            [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in table.keys], "left_anti").withColumn("op", F.lit("d"))
        table.write_batch(rows.unionByName(old, allowMissingColumns=True).withColumn("seq", F.lit(b).cast("bigint")), b)

    def _process(self, batch: DataFrame, b: int) -> None:
        alarms = batch.where("tbl = 'alarm'").select("op", "seq", *self.ALARM)
        source = batch.where("tbl = 'reading'")
        readings = self._facts(source)
        a0, a1, a = self._change(self.alarms, alarms, b)
        r0, r1, r = self._change(self.readings, readings, b)
        self._index(self.alarms_at, a0, a1, "occurred_at", b)
        self._index(self.readings_at, r0, r1, "monitoring_time", b)
        # alarms of this batch against all readings around them, as they are now and as they were
        now = self._at(self.readings_at, b, self._around(a1, "occurred_at"), r1)
        was = self._at(self.readings_at, b - 1, self._around(a0, "occurred_at"), r0)
        # readings of this batch against the alarms around them that the batch does not change
        moved = r0.withColumn("sign", F.lit(-1)).unionByName(r1.withColumn("sign", F.lit(1)))
        others = self._at(self.alarms_at, b - 1, self._around(moved, "monitoring_time"), a0).join(
            a.select(F.col("alarm_id").alias("_a")), F.col("alarm_id") == F.col("_a"), "left_anti")
        parts = [self._rows(a1, S.alarm_sums(a1, now, self.minutes), 1, 1),
                 self._rows(a0, S.alarm_sums(a0, was, self.minutes), -1, -1),
                 self._rows(others, S.alarm_sums(others, moved, self.minutes, sign=F.col("sign")), 0, 1, "inner")]
        touched = self.by_day.add(parts[0].unionByName(parts[1]).unionByName(parts[2]), b)
        for df in (a, r, touched):
            df.unpersist()

    def _facts(self, source: DataFrame) -> DataFrame:
        """Change rows of readings with the power factor of the DWD readings."""
        return E.reading_facts(source, ["op", "seq"]).select("op", "seq", *self.READING)

    def _rows(self, alarms: DataFrame, sums: DataFrame, n: int, sign: int, how: str = "left") -> DataFrame:
        j = alarms.join(sums.drop("n"), "alarm_id", how).select(
            "equipment_id", F.to_date("occurred_at").alias("day"), F.lit(abs(n)).alias("n"),
            ((F.col("alarm_level") >= S.CRITICAL_LEVEL).cast("int") * abs(n)).alias("critical"), "pf_sum", "pf_n", "hot")
        return self.by_day.signed(j, F.lit(sign))

    def report(self, equipment: DataFrame, as_of: dt.datetime) -> DataFrame:
        """The rows of ``scenarios.alarm_status_join``, from one row per device and day."""
        e = equipment.select(F.col("equipment_id").alias("e_id"), "location")
        d = self.by_day.read()
        g = d.join(e, d.equipment_id == e.e_id).groupBy("location", "day").agg(
            F.sum("n").alias("total_incidents"), F.count(F.when(F.col("critical") > 0, 1)).alias("critical_devices"),
            F.sum("pf_sum").alias("pf_sum"), F.sum("pf_n").alias("pf_n"), F.sum("hot").alias("temperature_anomaly"))
        return S.alarm_report(g, as_of)
