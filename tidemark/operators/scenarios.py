"""The grid scenarios whose jobs are absent from the reference (only their
source and result DDL remain): dimension enrichment, alarm × status interval
join, and fault analysis. Formulas are ours, documented per function.

What an alarm needs from the readings of its time window are sums and the last
value. ``window_sums`` gets them from running sums per (device, time bucket): the
ends of a window are placed among the readings, and the difference of the two
running sums is the window's sum. Rows grow with alarms plus readings; no
alarm x reading pair is formed, and one busy device is spread over tasks by time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rules as R

# Fixed labels of the scenario reports.
FINAL_REPORT_TYPE = "DEVICE_DIMENSION_REPORT"
ALARM_REPORT_TYPE = "ALARM_STATUS_ANALYSIS"
FAULT_ANALYSIS_TYPE = "FAULT_ANALYSIS"
ACTIONS = {"HIGH": "立即派员检修并降低负载", "MEDIUM": "加强巡检并跟踪温度", "LOW": "保持常规监控"}
PRIORITY = {"HIGH": "P1", "MEDIUM": "P2", "LOW": "P3"}
ROOT_CAUSE = [("FAULT", "设备故障"), ("CRITICAL", "严重运行异常"), ("WARNING", "运行参数越限"),
              ("INFO", "运行信息")]
CRITICAL_LEVEL = 4  # alarms from this level on make a device critical
RECOVERY = {"URGENT": "立即停机检修", "HIGH": "安排计划检修"}


ts_lit = R.ts_lit


def _micros(c: F.Column) -> F.Column:
    return F.unix_micros(F.to_timestamp(c))


def _bucket(ts: F.Column, minutes: int) -> F.Column:
    return F.floor(_micros(ts) / F.lit(minutes * 60_000_000)).cast("bigint")


def range_join(left: DataFrame, right: DataFrame, key: str, lts: str, rts: str,
               before_min: int, after_min: int) -> DataFrame:
    """left ⋈ right on ``key`` with ``rts`` in [lts − before, lts + after] (inclusive).

    Bucket width = before + after (≥ 1 minute); a left row is exploded into the
    buckets its range overlaps (at most 3), the right row sits in one bucket."""
    width = max(1, before_min + after_min)
    lo = _bucket(F.timestamp_add("MINUTE", F.lit(-before_min), F.col(lts)), width)
    hi = _bucket(F.timestamp_add("MINUTE", F.lit(after_min), F.col(lts)), width)
    l2 = left.withColumn("_b", F.explode(F.sequence(lo, hi)))
    r2 = right.withColumn("_b", _bucket(F.col(rts), width)).withColumnRenamed(key, "_rk")
    j = l2.join(r2, (l2[key] == r2["_rk"]) & (l2["_b"] == r2["_b"]), "inner")
    cond = (F.col(rts) >= F.timestamp_add("MINUTE", F.lit(-before_min), F.col(lts))) & \
           (F.col(rts) <= F.timestamp_add("MINUTE", F.lit(after_min), F.col(lts)))
    return j.where(cond).drop("_b", "_rk")


def window_sums(left: DataFrame, right: DataFrame, key: str, left_id: str, lo: Column, hi: Column, rts: str,
                sums: dict[str, Column], last: tuple[str, str] | None = None, bucket_min: int = 60,
                sums_until: Column | None = None, sign: Column | None = None) -> DataFrame:
    """For each ``left_id``: ``n`` and ``sums`` over the right rows of its ``key`` with ``rts`` in
    [lo, hi] (microseconds, inclusive), and with ``last = (value, tiebreak)`` the value of the
    last of them. ``sums_until`` ends the sums (and ``n``) earlier than the window, in the same pass.
    With ``sign`` right rows count that often (-1 takes one back), and a left row comes out if any is in its
    window. Left rows whose window holds no right row do not come out."""
    width = bucket_min * 60_000_000

    def bucket(t: Column) -> Column:
        return ((t - F.pmod(t, F.lit(width))) / width).cast("bigint")

    def point(t: Column, order: Column | int, sign: int, is_last: bool = False) -> Column:
        # window ends sort before or after readings of their time
        order = F.lit(order) if isinstance(order, int) else order
        return F.struct(t.alias("_t"), order.alias("_o"), F.lit(sign).alias("_s"), F.lit(is_last).alias("_l"))
    spans = left.where(F.col(key).isNotNull()).select(
        key, left_id, lo.alias("_lo"), hi.alias("_hi"), (hi if sums_until is None else sums_until).alias("_until"))
    spans = spans.where("_lo <= _hi").withColumn("_b", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi")))))
    first, end = F.greatest(F.col("_lo"), F.col("_b") * width), F.least(F.col("_hi"), (F.col("_b") + 1) * width - 1)
    until = F.least(F.col("_until"), end)
    points = [point(first, 0, -1)]
    if sums_until is None:
        points.append(point(end, 2, 1, last is not None))
    else:  # sums that end before this bucket's part of the window take back what its begin takes away
        none = until < first
        points += [point(F.when(none, first).otherwise(until), F.when(none, 0).otherwise(2), 1), point(end, 2, 0, True)]
    ends = spans.withColumn("_first", first).select(key, left_id, "_b", "_first", F.explode(F.array(*points)).alias("_p")).select(
        key, left_id, "_b", "_first", "_p.*")
    t = _micros(F.col(rts))
    values = {"n": F.lit(1).cast("bigint"), **sums}
    if sign is not None:
        values = {n: v * sign for n, v in values.items()} | {"_any": F.lit(1).cast("bigint")}
    rows = right.where(F.col(key).isNotNull() & F.col(rts).isNotNull()).select(
        key, bucket(t).alias("_b"), t.alias("_t"), F.lit(1).alias("_o"), *[v.alias(n) for n, v in values.items()],
        *([F.struct(t.alias("t"), F.col(last[1]).alias("tie"), F.col(last[0]).alias("value")).alias("_last")] if last else []))
    run = Window.partitionBy(key, "_b").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = ends.unionByName(rows, allowMissingColumns=True)
    sofar = both.select(left_id, "_o", "_s", "_l", "_first", *[F.sum(n).over(run).alias(n) for n in values],
                        *([F.max("_last").over(run).alias("_last")] if last else [])).where("_o <> 1")
    totals = [F.sum(F.coalesce(F.col(n), F.lit(0)) * F.col("_s")).alias(n) for n in values]
    if last:
        totals.append(F.max(F.when(F.col("_l") & (F.col("_last.t") >= F.col("_first")), F.col("_last"))).alias("_last"))
    out = sofar.groupBy(left_id).agg(*totals)
    if sign is not None:
        return out.where("_any > 0").drop("_any")
    if not last:
        return out.where("n > 0")
    return out.where("n > 0 OR _last IS NOT NULL").withColumn("last", F.col("_last.value")).drop("_last")


# ---------------------------------------------------------------- scenario 1

def enrich_from_dimension(readings: DataFrame, devices: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Readings (device_id, voltage, temperature, …) enriched by the device
    dimension, reported per location: devices, efficiency score (mean
    efficiency ×100 over readings), health, alert summary, grade."""
    per_device = readings.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("temperature").alias("t"), F.count("temperature").alias("t_n"),
        F.count(F.when(F.col("temperature") > 70, 1)).alias("hot"),
        F.count(F.when(~F.col("voltage").between(200, 240), 1)).alias("badv"))
    d = devices.select(F.col("device_id").alias("d_id"), "location", "efficiency_rate")
    j = per_device.join(d, per_device.device_id == d.d_id, "inner")
    rate = (F.col("efficiency_rate") * 100).cast("decimal(18,2)")
    g = j.groupBy("location").agg(
        F.count(F.lit(1)).alias("total_devices"),
        F.round(F.sum(rate * F.col("n")) / F.sum(F.when(rate.isNotNull(), F.col("n"))), 2).cast("double").alias("_score"),
        F.try_divide(F.sum("t"), F.sum("t_n")).alias("_t"), F.sum("hot").alias("_hot"), F.sum("badv").alias("_badv"))
    score = F.col("_score")
    return g.select(
        F.concat(F.lit("FINAL_"), F.col("location")).alias("report_id"),
        F.lit(FINAL_REPORT_TYPE).alias("report_type"), "location", "total_devices",
        score.alias("efficiency_score"),
        F.when(F.col("_t") > 60, "WARNING").otherwise("HEALTHY").alias("health_status"),
        F.concat(F.lit("high_temp="), F.col("_hot").cast("string"), F.lit(";abnormal_voltage="),
                 F.col("_badv").cast("string")).alias("alert_summary"),
        F.when(score >= 90, "A").when(score >= 85, "B").otherwise("C").alias("performance_grade"),
        ts_lit(as_of).alias("report_time"))


# ---------------------------------------------------------------- scenario 2

def alarm_status_join(alarms: DataFrame, readings: DataFrame, equipment: DataFrame, as_of: dt.datetime,
                      minutes: int = 10) -> DataFrame:
    """Alarms joined with the same device's readings within ±``minutes``,
    reported per (location, alarm day): incidents, critical devices, power-factor
    deficit of the matched readings, temperature anomalies, risk, actions."""
    a = alarms.select("alarm_id", "equipment_id", "alarm_level", "occurred_at")
    per_alarm = alarm_sums(a, readings, minutes).drop("n")
    e = equipment.select(F.col("equipment_id").alias("e_id"), "location")
    full = a.join(per_alarm, "alarm_id", "left").join(e, a.equipment_id == e.e_id, "inner")
    g = full.groupBy("location", F.to_date("occurred_at").alias("day")).agg(
        F.count(F.lit(1)).alias("total_incidents"),
        F.countDistinct(F.when(F.col("alarm_level") >= CRITICAL_LEVEL, F.col("equipment_id"))).alias("critical_devices"),
        F.sum("pf_sum").alias("pf_sum"), F.sum("pf_n").alias("pf_n"),
        F.coalesce(F.sum("hot"), F.lit(0)).cast("bigint").alias("temperature_anomaly"))
    return alarm_report(g, as_of)


def alarm_sums(alarms: DataFrame, readings: DataFrame, minutes: int = 10, sign: Column | None = None) -> DataFrame:
    """alarm_id, n, pf_sum, pf_n, hot over the readings of the alarm's device within ``minutes`` of it."""
    at, reach = _micros(F.col("occurred_at")), minutes * 60_000_000
    return window_sums(alarms, readings, "equipment_id", "alarm_id", at - reach, at + reach, "monitoring_time", {
        "pf_sum": F.col("power_factor").cast("decimal(18,4)"),
        "pf_n": F.col("power_factor").isNotNull().cast("bigint"),
        "hot": F.coalesce((F.col("temperature") > 70).cast("bigint"), F.lit(0))}, sign=sign)


def alarm_report(g: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The report rows from the sums of a location and day."""
    risk = (F.when((F.col("critical_devices") > 0) & (F.col("temperature_anomaly") > 0), "HIGH")
            .when((F.col("critical_devices") > 0) | (F.col("temperature_anomaly") > 0), "MEDIUM")
            .otherwise("LOW"))
    return g.select(
        F.concat(F.lit("ALARM_"), F.col("location"), F.lit("_"), F.date_format("day", "yyyyMMdd")).alias("report_id"),
        F.lit(ALARM_REPORT_TYPE).alias("report_type"), F.date_format("day", "yyyy-MM-dd").alias("time_period"),
        "location", "total_incidents", "critical_devices",
        F.round((F.lit(1.0) - F.round(F.try_divide("pf_sum", "pf_n"), 4).cast("double")) * 100, 2)
        .alias("efficiency_impact"),
        "temperature_anomaly", risk.alias("risk_assessment"),
        F.when(risk == "HIGH", ACTIONS["HIGH"]).when(risk == "MEDIUM", ACTIONS["MEDIUM"])
        .otherwise(ACTIONS["LOW"]).alias("suggested_actions"),
        F.when(risk == "HIGH", PRIORITY["HIGH"]).when(risk == "MEDIUM", PRIORITY["MEDIUM"])
        .otherwise(PRIORITY["LOW"]).alias("priority_level"),
        ts_lit(as_of).alias("report_time"))


def alarm_status_join_stream(alarms: DataFrame, readings: DataFrame, minutes: int = 10, watermark: str = "10 minutes") -> DataFrame:
    """The pairs as a plain stream-stream join. The watermarks bound its state, and with it how late a row may be:
    use it where ``watermark`` covers the lateness. ``streaming.grid_totals.AlarmTotals`` keeps both sides and
    counts rows however late they come."""
    a = alarms.withWatermark("occurred_at", watermark).alias("a")
    r = readings.withWatermark("monitoring_time", watermark).alias("r")
    cond = (F.col("a.equipment_id") == F.col("r.equipment_id")) & \
           (F.col("r.monitoring_time") >= F.col("a.occurred_at") - F.expr(f"INTERVAL {minutes} MINUTES")) & \
           (F.col("r.monitoring_time") <= F.col("a.occurred_at") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return a.join(r, cond, "inner").select("a.alarm_id", "a.equipment_id", "a.occurred_at", "r.monitoring_id",
                                           "r.monitoring_time", "r.temperature", "r.power_factor")


# ---------------------------------------------------------------- scenario 3

def fault_analysis(alarms: DataFrame, readings: DataFrame, as_of: dt.datetime, window_min: int = 60,
                   fault_level: int = 4) -> DataFrame:
    """Per fault (alarm level ≥ ``fault_level``): mean active power of the
    device's readings in the ``window_min`` minutes before the fault, the newest
    reading at or before the fault within that window (as-of), and the
    degradation between them in %."""
    f = alarms.where(F.col("alarm_level") >= fault_level).select(
        "alarm_id", "equipment_id", "alarm_type", "alarm_level", "alarm_code", "occurred_at")
    r = readings.select("equipment_id", "monitoring_id", "monitoring_time", "power_active")
    at = _micros(F.col("occurred_at"))
    lo = at - window_min * 60_000_000
    faults = f.select("alarm_id", "equipment_id", "occurred_at")
    power = {"p_sum": F.col("power_active").cast("decimal(18,2)"), "p_n": F.col("power_active").isNotNull().cast("bigint")}
    # one pass over the readings: the sums end before the fault, the as-of value is taken at it
    per = window_sums(faults, r, "equipment_id", "alarm_id", lo, at, "monitoring_time", power,
                      last=("power_active", "monitoring_id"), sums_until=at - 1).select(
        "alarm_id", F.round(F.try_divide("p_sum", "p_n"), 4).cast("double").alias("pre"), F.col("last").alias("at_fault"))
    j = f.join(per, "alarm_id", "left")
    prio = F.when(F.col("alarm_level") >= 5, "URGENT").otherwise("HIGH")
    cause = None
    for k, v in ROOT_CAUSE:
        cause = F.when(F.col("alarm_type") == k, v) if cause is None else cause.when(F.col("alarm_type") == k, v)
    return j.select(
        F.concat(F.lit("FAULT_"), F.col("alarm_id").cast("string")).alias("analysis_id"),
        F.col("equipment_id").alias("device_id"), F.lit(FAULT_ANALYSIS_TYPE).alias("analysis_type"),
        F.date_format("occurred_at", "yyyyMMddHH").alias("fault_time_period"),
        F.col("pre").alias("pre_fault_performance"),
        F.concat(F.lit("level="), F.col("alarm_level").cast("string"), F.lit(";code="), F.col("alarm_code"))
        .alias("fault_indicators"),
        cause.otherwise("其他").alias("root_cause_analysis"),
        F.round(F.try_divide(F.col("pre") - F.col("at_fault"), F.col("pre")) * 100, 2)
        .alias("performance_degradation"),
        F.when(prio == "URGENT", RECOVERY["URGENT"]).otherwise(RECOVERY["HIGH"]).alias("recovery_suggestions"),
        prio.alias("maintenance_priority"), ts_lit(as_of).alias("analysis_time"))
