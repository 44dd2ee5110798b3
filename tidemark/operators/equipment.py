"""Equipment monitoring warehouse: equipment / monitoring / alarm detail rows,
latest-reading status, alarm statistics and the DDL-only summary and
application tables (their formulas are ours and documented per function).

Facts (readings, alarms) are the large side; the equipment master is joined as
a dimension (AQE broadcasts it at run time when it is measured small).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.operators.metrics import metric_rows

# Type codes, alarm level names and categories, health texts.
TYPE_CODES = [("变压器", "TR"), ("发电机", "GE"), ("输电线路", "TL"), ("配电设备", "DE")]
LEVEL_NAMES = [(1, "提示"), (2, "一般"), (3, "重要"), (4, "严重"), (5, "紧急")]
ALARM_CATEGORIES = [("FAULT", "设备故障"), ("CRITICAL", "严重告警"), ("WARNING", "运行预警"),
                    ("INFO", "运行信息")]
CAPACITY_LEVELS = ("小型", "中型", "大型")
HEALTH_LEVELS = ("优秀", "良好", "一般", "差")
HEALTH_ADVICE = ("保持常规巡检", "按计划维护", "尽快安排检修", "立即停机检修")
QUALITY_LEVELS = ("优", "良", "中", "差")
SYSTEM_STATUS = ("正常", "告警", "故障")


def _map(c: F.Column, pairs, default=None) -> F.Column:
    e = None
    for k, v in pairs:
        e = F.when(c == k, v) if e is None else e.when(c == k, v)
    return e.otherwise(default) if default is not None else e


def _d(day: dt.date) -> F.Column:
    return F.lit(day.isoformat()).cast("date")


ts_lit = R.ts_lit


# ------------------------------------------------------------------- DWD

def dwd_power_equipment(equipment: DataFrame, small: float = 100, large: float = 250) -> DataFrame:
    """Type code, location split, voltage code, capacity level, install year,
    maintenance interval, is_critical (voltage ≥ 220 kV or capacity ≥ ``large``)."""
    loc, cap = F.col("location"), F.col("capacity_mw")
    vcode = F.regexp_extract(F.col("voltage_level"), r"^([0-9]+)", 1).cast("int")
    return equipment.select(
        "equipment_id", "equipment_name", "equipment_type",
        _map(F.col("equipment_type"), TYPE_CODES, "OT").alias("equipment_type_code"),
        "location", F.substring(loc, 1, 2).alias("province"), F.substring(loc, 1, 2).alias("city"),
        F.when(F.length(loc) > 2, F.substr(loc, F.lit(3))).alias("district"),
        "voltage_level", vcode.alias("voltage_level_code"), "capacity_mw",
        F.when(cap < small, CAPACITY_LEVELS[0]).when(cap < large, CAPACITY_LEVELS[1])
        .otherwise(CAPACITY_LEVELS[2]).alias("capacity_level"),
        "installation_date", F.year("installation_date").alias("installation_year"),
        "last_maintenance_date",
        F.datediff("last_maintenance_date", "installation_date").alias("maintenance_interval_days"),
        "status", ((vcode >= 220) | (cap >= large)).alias("is_critical"))


def _imbalance(a, b, c, avg) -> F.Column:
    dev = F.greatest(F.abs(a - avg), F.abs(b - avg), F.abs(c - avg))
    return F.round(R.safe_div(dev, avg), 4)


def dwd_power_monitoring(monitoring: DataFrame, equipment: DataFrame) -> DataFrame:
    """3-phase averages and imbalance (max deviation / mean), apparent power
    √(P²+Q²), power factor P/S, frequency deviation from 50 Hz, calendar parts,
    peak hour (08–11, 17–21) and working day (Mon–Fri)."""
    e = equipment.select(F.col("equipment_id").alias("e_id"), "equipment_name", "equipment_type")
    return _readings(monitoring.join(e, monitoring.equipment_id == e.e_id, "left"), ["equipment_name", "equipment_type"])


def reading_facts(monitoring: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The DWD readings for consumers that read no equipment column: ``equipment_id`` is the
    equipment's key, so the left join keeps one row per reading and can be left out.
    ``extra`` columns of the source are passed on (a change row's op and seq)."""
    return _readings(monitoring, extra or [])


def _readings(m: DataFrame, dimension: list[str]) -> DataFrame:
    va, vb, vc = F.col("voltage_a"), F.col("voltage_b"), F.col("voltage_c")
    ca, cb, cc = F.col("current_a"), F.col("current_b"), F.col("current_c")
    vavg, cavg = (va + vb + vc) / 3, (ca + cb + cc) / 3
    p, q = F.col("power_active"), F.col("power_reactive")
    s = F.sqrt(p * p + q * q)
    t = F.col("monitoring_time")
    hr = F.hour(t)
    return m.select(
        "monitoring_id", "equipment_id", *dimension,
        va, vb, vc, F.round(vavg, 2).alias("voltage_avg"), _imbalance(va, vb, vc, vavg).alias("voltage_imbalance"),
        ca, cb, cc, F.round(cavg, 2).alias("current_avg"), _imbalance(ca, cb, cc, cavg).alias("current_imbalance"),
        p, q, F.round(R.safe_div(p, s), 4).alias("power_factor"), F.round(s, 2).alias("power_apparent"),
        "frequency", F.round(F.col("frequency") - 50, 4).alias("frequency_deviation"),
        "temperature", "humidity",
        F.to_date(t).alias("monitoring_date"), hr.alias("monitoring_hour"), F.minute(t).alias("monitoring_minute"),
        (hr.between(8, 11) | hr.between(17, 21)).alias("is_peak_hour"),
        (F.weekday(t) < 5).alias("is_working_day"), t.alias("monitoring_time"))


def dwd_equipment_alarms(alarms: DataFrame, equipment: DataFrame) -> DataFrame:
    e = equipment.select(F.col("equipment_id").alias("e_id"), "equipment_name", "equipment_type")
    return _alarms(alarms.join(e, alarms.equipment_id == e.e_id, "left"), ["equipment_name", "equipment_type"])


def alarm_facts(alarms: DataFrame) -> DataFrame:
    """The DWD alarms for consumers that read no equipment column (see ``reading_facts``)."""
    return _alarms(alarms, [])


def _alarms(a: DataFrame, dimension: list[str]) -> DataFrame:
    return a.select(
        "alarm_id", "equipment_id", *dimension, "alarm_type", "alarm_level",
        _map(F.col("alarm_level"), LEVEL_NAMES).alias("alarm_level_name"), "alarm_message", "alarm_code",
        _map(F.col("alarm_type"), ALARM_CATEGORIES, "其他").alias("alarm_category"), "is_resolved",
        R.minutes_between("occurred_at", "resolved_at").cast("int").alias("resolution_time_minutes"),
        F.to_date("occurred_at").alias("occurred_date"), F.hour("occurred_at").alias("occurred_hour"),
        "occurred_at", "resolved_at")


# ------------------------------------------------------------ status views

def latest_readings(dmon: DataFrame) -> DataFrame:
    """Every reading at its equipment's newest monitoring_time (ties kept).

    MAX per equipment is a partial aggregate (a hot equipment is combined
    map-side); the way back to the rows joins on (equipment_id, time), so one
    equipment's readings spread over tasks by time instead of one task."""
    newest = dmon.groupBy(F.col("equipment_id").alias("n_eid")).agg(
        F.max("monitoring_time").alias("n_time"))
    return dmon.join(newest, (dmon.equipment_id == newest.n_eid) & (dmon.monitoring_time == newest.n_time),
                     "left_semi")


def latest_status(dequip: DataFrame, dmon: DataFrame, as_of: dt.datetime, online_minutes: int = 10) -> DataFrame:
    """Equipment with its newest reading; ONLINE when newer than ``online_minutes``.
    Equipment without readings drop out (the reference's WHERE does the same)."""
    lr = latest_readings(dmon).select(
        F.col("equipment_id").alias("m_eid"), "voltage_avg", "current_avg", "power_active",
        "power_factor", "frequency", "temperature", "monitoring_time")
    e = dequip.select("equipment_id", "equipment_name", "equipment_type", "location", "voltage_level",
                      "capacity_mw", "status")
    j = e.join(lr, e.equipment_id == lr.m_eid, "inner")
    cut = F.timestamp_add("MINUTE", F.lit(-online_minutes), ts_lit(as_of))
    return j.drop("m_eid").withColumn(
        "connection_status", F.when(F.col("monitoring_time") > cut, "ONLINE").otherwise("OFFLINE"))


def alarm_statistics(dalarms: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    since = F.lit((as_of.date() - dt.timedelta(days=days)).strftime("%Y-%m-%d 00:00:00")).cast("timestamp_ntz")
    a = dalarms.where(F.col("occurred_at") >= since)
    return a.groupBy("equipment_type", "alarm_type", "alarm_level").agg(
        F.count(F.lit(1)).alias("total_count"),
        R.count_if(F.col("is_resolved")).alias("resolved_count"),
        R.count_if(~F.col("is_resolved")).alias("unresolved_count"),
        F.avg("resolution_time_minutes").alias("avg_resolution_time"))


# ----------------------------------------------------- DDL-only summary tables

def abnormal(v: F.Column, f: F.Column) -> F.Column:
    return ~v.between(200, 240) | ~f.between(49.5, 50.5)


def equipment_daily_summary(readings: DataFrame, equipment: DataFrame) -> DataFrame:
    """Per equipment and day: voltage/current/power statistics, sample std of
    voltage, abnormal readings (voltage outside 200–240 or frequency outside
    49.5–50.5), uptime = hours with a reading, utilisation = mean power / capacity."""
    v = F.col("voltage_avg")
    g = readings.groupBy("equipment_id", F.col("monitoring_date").alias("summary_date")).agg(
        R.avg_round(v, 2, 2).alias("voltage_avg"), F.max(v).alias("voltage_max"), F.min(v).alias("voltage_min"),
        F.round(F.stddev_samp(v), 4).alias("voltage_std"),
        R.avg_round("current_avg", 2, 2).alias("current_avg"), F.max("current_avg").alias("current_max"),
        F.min("current_avg").alias("current_min"),
        R.avg_round("power_active", 2, 2).alias("power_active_avg"),
        F.max("power_active").alias("power_active_max"), F.min("power_active").alias("power_active_min"),
        R.avg_round("power_factor", 4, 4).alias("power_factor_avg"),
        R.avg_round("frequency", 2, 3).alias("frequency_avg"),
        R.avg_round("temperature", 2, 2).alias("temperature_avg"), F.max("temperature").alias("temperature_max"),
        F.count(F.lit(1)).alias("monitoring_count"),
        R.count_if(abnormal(v, F.col("frequency"))).alias("abnormal_count"),
        # hours with a reading: a 24-bit mask per group (no distinct aggregate)
        F.bit_count(F.bit_or(F.pow(F.lit(2), F.col("monitoring_hour")).cast("bigint"))).cast("double")
        .alias("uptime_hours"),
        F.sum("power_active").alias("_p_sum"), F.count("power_active").alias("_p_n"))
    return daily_report(g, equipment)


def daily_report(g: DataFrame, equipment: DataFrame) -> DataFrame:
    """Daily figures with the equipment's names and its utilisation from ``_p_sum`` and ``_p_n``."""
    # one join per group, not per reading
    cap = equipment.select(F.col("equipment_id").alias("c_eid"), "equipment_name", "equipment_type", "capacity_mw")
    j = g.join(cap, g.equipment_id == cap.c_eid, "left")
    return j.select(
        (F.col("equipment_id") * 100000 + F.datediff("summary_date", F.lit("1970-01-01").cast("date")))
        .alias("summary_id"),
        "equipment_id", "equipment_name", "equipment_type",
        *[c for c in g.columns if not c.startswith("_") and c != "equipment_id"],
        F.round(R.safe_div(F.try_divide("_p_sum", "_p_n"), F.nullif(F.col("capacity_mw"), F.lit(0.0))), 4)
        .alias("utilization_rate"))


def alarm_daily_summary(dalarms: DataFrame) -> DataFrame:
    lvl = F.col("alarm_level")
    g = dalarms.groupBy(F.col("occurred_date").alias("summary_date"), "equipment_type", "alarm_type",
                        "alarm_level").agg(
        F.count(F.lit(1)).alias("total_alarms"),
        R.count_if(F.col("is_resolved")).alias("resolved_alarms"),
        R.count_if(~F.col("is_resolved")).alias("unresolved_alarms"),
        F.round(F.avg("resolution_time_minutes"), 2).alias("avg_resolution_time_minutes"),
        F.max("resolution_time_minutes").alias("max_resolution_time_minutes"),
        R.count_if(lvl >= 4).alias("critical_alarms"),
        R.count_if(lvl.isin(2, 3)).alias("warning_alarms"),
        R.count_if(lvl == 1).alias("info_alarms"))
    return g


def equipment_dashboard(dequip: DataFrame, dalarms: DataFrame, latest: DataFrame,
                        as_of: dt.datetime) -> DataFrame:
    """One wide row. Each source is scanned once into a one-row aggregate; the
    rows are unpivoted, unioned and pivoted back by a single global aggregate."""
    st = F.col("status")
    e = dequip.agg(
        F.count(F.lit(1)).alias("total_equipment"),
        R.count_if(st == "ACTIVE").alias("online_equipment"),
        R.count_if(st == "INACTIVE").alias("offline_equipment"),
        R.count_if(st == "MAINTENANCE").alias("maintenance_equipment"),
        F.sum("capacity_mw").alias("total_capacity_mw"),
        F.coalesce(F.sum(F.when(st == "ACTIVE", F.col("capacity_mw"))), F.lit(0.0)).alias("active_capacity_mw"))
    open_ = ~F.col("is_resolved")
    a = dalarms.agg(
        R.count_if(open_).alias("total_active_alarms"),
        R.count_if(open_ & (F.col("alarm_level") >= 4)).alias("critical_alarms"),
        R.count_if(open_ & F.col("alarm_level").isin(2, 3)).alias("warning_alarms"))
    lv = F.col("voltage_level")
    r = latest.agg(
        F.sum(F.when(st == "ACTIVE", F.col("power_active"))).alias("active_power"),
        F.avg(F.when(lv == "220kV", F.col("voltage_avg"))).alias("avg_voltage_220kv"),
        F.avg(F.when(lv == "110kV", F.col("voltage_avg"))).alias("avg_voltage_110kv"),
        F.avg("frequency").alias("avg_frequency"))
    names_e = ["total_equipment", "online_equipment", "offline_equipment", "maintenance_equipment",
               "total_capacity_mw", "active_capacity_mw"]
    names_a = ["total_active_alarms", "critical_alarms", "warning_alarms"]
    names_r = ["active_power", "avg_voltage_220kv", "avg_voltage_110kv", "avg_frequency"]
    rows = metric_rows(e, names_e).unionByName(metric_rows(a, names_a)).unionByName(metric_rows(r, names_r))
    k, v = F.col("metric_name"), F.col("metric_value")
    w = rows.agg(*[F.max(F.when(k == n, v)).alias(n) for n in names_e + names_a + names_r])
    d = as_of.date()
    crit, act = F.col("critical_alarms"), F.col("total_active_alarms")
    return w.select(
        F.lit(int(d.strftime("%Y%m%d"))).cast("bigint").alias("dashboard_id"),
        *[F.col(n).cast("bigint").alias(n) for n in names_e[:4]],
        F.round(F.col("total_capacity_mw"), 2).alias("total_capacity_mw"),
        F.round(F.col("active_capacity_mw"), 2).alias("active_capacity_mw"),
        F.round(R.safe_div(F.col("active_power"), F.nullif(F.col("active_capacity_mw"), F.lit(0.0))), 4)
        .alias("load_rate"),
        *[F.col(n).cast("bigint").alias(n) for n in names_a],
        F.round(F.col("avg_voltage_220kv"), 2).alias("avg_voltage_220kv"),
        F.round(F.col("avg_voltage_110kv"), 2).alias("avg_voltage_110kv"),
        F.round(F.col("avg_frequency"), 3).alias("avg_frequency"),
        F.when(crit > 0, SYSTEM_STATUS[2]).when(act > 0, SYSTEM_STATUS[1]).otherwise(SYSTEM_STATUS[0])
        .alias("system_status"),
        ts_lit(as_of).alias("last_updated"))


def power_quality(dmon: DataFrame, nominal_v: float = 220.0, v_tol: float = 0.07,
                  f_tol: float = 0.2, imbalance_limit: float = 0.02) -> DataFrame:
    """Per date: voltage / frequency qualification rates (0–1), mean power
    factor, voltage / current imbalance rates, score and level. No harmonic
    source column exists, so harmonic_distortion_rate is NULL."""
    v, f = F.col("voltage_avg"), F.col("frequency")
    vok = v.between(nominal_v * (1 - v_tol), nominal_v * (1 + v_tol))
    fok = F.abs(f - 50) <= f_tol
    n = F.count(F.lit(1))
    g = dmon.groupBy(F.col("monitoring_date").alias("analysis_date")).agg(
        (R.count_if(vok) / n).alias("vq"), (R.count_if(fok) / n).alias("fq"),
        F.avg("power_factor").alias("pf"),
        (R.count_if(F.col("voltage_imbalance") > imbalance_limit) / n).alias("vi"),
        (R.count_if(F.col("current_imbalance") > imbalance_limit) / n).alias("ci"))
    score = F.round((F.col("vq") * 0.4 + F.col("fq") * 0.4 + F.coalesce(F.col("pf"), F.lit(0.0)) * 0.2) * 100, 2)
    return g.select(
        F.date_format("analysis_date", "yyyyMMdd").cast("bigint").alias("analysis_id"), "analysis_date",
        F.round("vq", 4).alias("voltage_qualification_rate"), F.round("fq", 4).alias("frequency_qualification_rate"),
        F.round("pf", 4).alias("power_factor_avg"), F.round("vi", 4).alias("voltage_imbalance_rate"),
        F.round("ci", 4).alias("current_imbalance_rate"),
        F.lit(None).cast("double").alias("harmonic_distortion_rate"),
        score.alias("power_quality_score"),
        F.when(score >= 90, QUALITY_LEVELS[0]).when(score >= 80, QUALITY_LEVELS[1])
        .when(score >= 60, QUALITY_LEVELS[2]).otherwise(QUALITY_LEVELS[3]).alias("quality_level"))


def equipment_health(dequip: DataFrame, dmon: DataFrame, dalarms: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rule-based health per equipment (no failure model exists in the source):
    score = 100 − 50·open-alarm share − 30·open-critical share − max(0, mean temp − 60),
    floored at 0; reliability = % alarms resolved (100 without alarms);
    urgency 1–5 and failure probability (1 − score/100) follow the score."""
    al = dalarms.groupBy(F.col("equipment_id").alias("a_eid")).agg(
        F.count(F.lit(1)).alias("n_alarms"),
        R.count_if(~F.col("is_resolved")).alias("n_open"),
        R.count_if(~F.col("is_resolved") & (F.col("alarm_level") >= 4)).alias("n_open_crit"),
        R.count_if(F.col("is_resolved")).alias("n_resolved"))
    mt = dmon.groupBy(F.col("equipment_id").alias("m_eid")).agg(F.avg("temperature").alias("avg_temp"))
    e = dequip.select("equipment_id", "equipment_name", "equipment_type")
    j = e.join(al, e.equipment_id == al.a_eid, "left").join(mt, e.equipment_id == mt.m_eid, "left")
    share = lambda c: F.coalesce(F.col(c) / F.col("n_alarms"), F.lit(0.0))
    temp_pen = F.greatest(F.lit(0.0), F.coalesce(F.col("avg_temp"), F.lit(0.0)) - 60)
    score = F.round(F.greatest(F.lit(0.0), F.lit(100.0) - share("n_open") * 50 - share("n_open_crit") * 30
                               - temp_pen), 2)
    lvl = (F.when(score >= 85, 0).when(score >= 70, 1).when(score >= 50, 2).otherwise(3))
    pick = lambda vals: F.when(lvl == 0, vals[0]).when(lvl == 1, vals[1]).when(lvl == 2, vals[2]).otherwise(vals[3])
    return j.select(
        (F.col("equipment_id") * 100000 + F.lit((as_of.date() - dt.date(1970, 1, 1)).days)).alias("assessment_id"),
        "equipment_id", "equipment_name", "equipment_type", score.alias("health_score"),
        pick(HEALTH_LEVELS).alias("health_level"),
        F.round(F.coalesce(F.col("n_resolved") * 100.0 / F.col("n_alarms"), F.lit(100.0)), 2).alias("reliability_score"),
        F.when(score < 50, 5).when(score < 70, 4).when(score < 85, 3).when(score < 95, 2).otherwise(1)
        .alias("maintenance_urgency"),
        F.round(F.lit(1.0) - score / 100, 4).alias("predicted_failure_probability"),
        (score * 36.5).cast("int").alias("remaining_life_days"),
        pick(HEALTH_ADVICE).alias("maintenance_recommendation"),
        _d(as_of.date()).alias("assessment_date"))


def columnar_report(dmon: DataFrame) -> DataFrame:
    """Scenario 4 (wide monitoring table, few columns read): per equipment and
    day, reading count and mean active power / temperature. Only three columns
    reach the Parquet scan."""
    return dmon.groupBy("equipment_id", F.to_date("monitoring_time").alias("report_date")).agg(
        F.count(F.lit(1)).alias("readings"),
        F.round(F.avg("power_active"), 6).alias("avg_power_active"),
        F.round(F.avg("temperature"), 6).alias("avg_temperature"))
