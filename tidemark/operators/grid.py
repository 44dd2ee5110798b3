"""Power-grid domain: conform the dispatch and device streams, derive the
dispatch × device detail measures, and build regional metrics and reports.

Scale notes
-----------
* The reference joins every dispatch with every device of the same 2-character
  region prefix. That output grows with |dispatch| × |devices per region| and
  only five prefixes exist, so a plain equi-join runs on five tasks.
  ``smart_grid_detail`` salts the join (dispatch rows hashed to one of N salt
  values, the smaller device side replicated N times) and is meant for bounded
  inputs: one micro-batch of dispatches, or a time window.
* Everything the layers *consume* from the detail is an aggregate per
  (region, hour). ``smart_grid_summary`` computes those aggregates exactly
  without materialising a single pair: each side is aggregated by region
  first, and pair counts/sums follow from products of the side aggregates
  (every dispatch of a region pairs with every device of that region).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rules as R

# Row-id prefix of the periodic full-refresh result path.
REFRESH_PREFIX = "REFRESH_"
# Fixed values of the dispatch conform step.
DISPATCH_COMMAND = "AUTO_DISPATCH"
RESPONSE_TIME_MS = 50


ts_lit = R.ts_lit


def epoch_text(as_of: dt.datetime) -> F.Column:
    """UNIX_TIMESTAMP(as_of) as text — the run key of the reference's row ids."""
    return F.unix_timestamp(ts_lit(as_of).cast("timestamp")).cast("string")


# --------------------------------------------------------------- conform (ODS)

def dispatch_source(dispatch_ods: DataFrame) -> DataFrame:
    """The change-source column names of the dispatch stream."""
    return dispatch_ods.select(
        "dispatch_id", "grid_region", F.col("event_time").alias("dispatch_time"),
        F.col("total_demand_mw").alias("load_demand_mw"),
        F.col("total_supply_mw").alias("supply_capacity_mw"), "emergency_level",
        "load_balance_status", F.col("frequency_hz").alias("grid_frequency_hz"),
        F.col("voltage_level_kv").alias("voltage_stability"))


def conform_dispatch(src: DataFrame) -> DataFrame:
    """Change-source dispatch columns → ODS names, constant command and response."""
    return src.select(
        "dispatch_id", F.col("dispatch_time").alias("event_time"), "grid_region",
        F.col("load_demand_mw").alias("total_demand_mw"),
        F.col("supply_capacity_mw").alias("total_supply_mw"),
        F.col("grid_frequency_hz").alias("frequency_hz"),
        F.col("voltage_stability").alias("voltage_level_kv"),
        "load_balance_status", "emergency_level",
        F.lit(DISPATCH_COMMAND).alias("dispatch_command"),
        F.lit(RESPONSE_TIME_MS).cast("bigint").alias("response_time_ms"))


def conform_device(devices: DataFrame) -> DataFrame:
    """Device source → ODS device dimension (status ACTIVE/MAINTENANCE/INACTIVE)."""
    return devices.select(
        "device_id", "device_name", "device_type", "location", "capacity_mw",
        R.maintenance_to_active(F.col("maintenance_status")).alias("status"),
        "real_time_voltage", "real_time_current", "real_time_temperature", "efficiency_rate",
        F.col("installation_date").alias("event_time"))


# ------------------------------------------------------------------ detail (DWD)

def smart_grid_detail(dispatch_ods: DataFrame, device_ods: DataFrame, salt: int = 8) -> DataFrame:
    """dispatch ⋈ device on equal 2-character region prefix, 8 derived measures.

    For bounded inputs (a micro-batch or time window): the output has one row
    per (dispatch, device) pair of a region. The join is salted so a hot region
    spreads over ``salt`` tasks instead of one."""
    d = dispatch_ods.select(
        "dispatch_id", "event_time", "grid_region", "total_demand_mw", "total_supply_mw",
        "frequency_hz", "voltage_level_kv", "load_balance_status", "emergency_level",
        R.region_prefix(F.col("grid_region")).alias("_p"),
        F.pmod(F.xxhash64("dispatch_id"), F.lit(salt)).alias("_s"))
    v = device_ods.select(
        "device_id", "device_type", "location", "status", "real_time_voltage",
        "real_time_temperature", "efficiency_rate",
        R.region_prefix(F.col("location")).alias("_p"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint"))).alias("_s"))
    j = d.join(v, ["_p", "_s"], "inner")
    eff, temp, freq = F.col("efficiency_rate"), F.col("real_time_temperature"), F.col("frequency_hz")
    return j.select(
        F.concat(F.col("dispatch_id").cast("string"), F.lit("_"), F.col("device_id").cast("string"))
        .alias("grid_detail_id"),
        "dispatch_id", "device_id", "grid_region", F.col("location").alias("device_location"),
        "device_type", F.col("event_time").alias("dispatch_time"),
        (F.col("total_supply_mw") - F.col("total_demand_mw")).alias("supply_demand_balance"),
        R.frequency_stability(freq).alias("frequency_stability"),
        R.voltage_quality(F.col("voltage_level_kv"), F.col("real_time_voltage")).alias("voltage_quality"),
        R.device_health_score(eff, temp, F.col("status")).alias("device_health_score"),
        R.grid_efficiency(F.col("total_supply_mw"), F.col("total_demand_mw"), eff).alias("grid_efficiency"),
        R.risk_level(F.col("emergency_level"), temp, eff, F.col("load_balance_status")).alias("risk_level"),
        R.operational_status(freq, eff).alias("operational_status"),
        "emergency_level")


def device_status_from_detail(detail: DataFrame, as_of: dt.datetime, minutes: int = 60) -> DataFrame:
    """Detail rows of the last ``minutes`` → device status rows (6-branch CASE,
    temperature simulated from the health band)."""
    lo = F.timestamp_add("MINUTE", F.lit(-minutes), ts_lit(as_of))
    d = detail.where(F.col("dispatch_time") >= lo)
    h = F.col("device_health_score")
    return d.select(
        F.concat(F.lit("DEVICE_SUMMARY_"), F.col("device_id").cast("string"), F.lit("_"),
                 F.date_format("dispatch_time", "yyyyMMddHHmmss")).alias("summary_id"),
        "device_id", "device_type", F.col("device_location").alias("location"),
        R.dashboard_status(F.col("operational_status"), F.col("risk_level")).alias("status"),
        F.col("supply_demand_balance").alias("load_factor"), h.alias("efficiency"),
        R.temperature_from_health(h).alias("temperature"),
        F.col("dispatch_time").alias("update_time"))


# ------------------------------------------------------------ summary (DWS)

def smart_grid_summary(dispatch_ods: DataFrame, device_ods: DataFrame) -> DataFrame:
    """Per (grid_region, hour yyyyMMddHH) aggregates of the detail pairs, computed
    exactly from per-side aggregates (no pair is materialised).

    Definitions (DDL-only table, formulas ours), all over the detail pairs:
    total_dispatches / total_devices = distinct dispatches / devices paired;
    avg_supply_demand_balance, avg_device_health, grid_efficiency_score = pair means;
    frequency_stability_rate = % pairs STABLE; voltage_quality_rate = % pairs
    EXCELLENT or GOOD; high_risk_incidents = pairs with HIGH_RISK;
    emergency_responses = dispatches with emergency level HIGH or CRITICAL.
    """
    dg = dispatch_measures(dispatch_ods).groupBy("_p", "grid_region", "time_window").agg(
        *[F.sum(c).alias(c) for c in DISPATCH_MEASURES])
    # one row per region prefix
    vg = device_measures(device_ods).groupBy("_p").agg(*[F.sum(c).alias(c) for c in DEVICE_MEASURES])
    j = dg.join(vg, "_p", "inner")
    return summary_of(j.withColumns({name: pair_sums(F.col)[name] for name in PAIR_SUMS}))


#: Sums that either side of the dispatch x device pairs contributes, by region-hour and by region prefix.
DISPATCH_MEASURES = ["nd", "s_bal", "n_bal", "nd_stable", "nd_kv600", "s_ratio", "n_ratio", "nd_crit", "nd_emerg"]
DEVICE_MEASURES = ["nv", "nv_v230", "s_health", "n_health", "s_eff", "n_eff", "nv_hot"]
#: Counts of pairs that are products of the two.
PAIR_SUMS = ["pairs", "good_voltage", "high_risk"]


def dispatch_measures(dispatch_ods: DataFrame) -> DataFrame:
    """What one dispatch adds to the sums of its region and hour."""
    ratio = F.try_divide(F.col("total_supply_mw"), F.col("total_demand_mw"))
    bal, level = F.col("total_supply_mw") - F.col("total_demand_mw"), F.col("emergency_level")
    return dispatch_ods.select(
        R.region_prefix(F.col("grid_region")).alias("_p"), "grid_region",
        F.date_format("event_time", "yyyyMMddHH").alias("time_window"), F.lit(1).cast("bigint").alias("nd"),
        bal.alias("s_bal"), _one(bal.isNotNull()).alias("n_bal"),
        _one(F.col("frequency_hz").between(49.9, 50.1)).alias("nd_stable"),
        _one(F.col("voltage_level_kv") > 600).alias("nd_kv600"), ratio.alias("s_ratio"), _one(ratio.isNotNull()).alias("n_ratio"),
        _one(level == "CRITICAL").alias("nd_crit"), _one(level.isin("HIGH", "CRITICAL")).alias("nd_emerg"))


def device_measures(device_ods: DataFrame) -> DataFrame:
    """What one device adds to the sums of its region."""
    eff, temp = F.col("efficiency_rate"), F.col("real_time_temperature")
    health = R.device_health_score(eff, temp, F.col("status"))
    return device_ods.select(
        R.region_prefix(F.col("location")).alias("_p"), F.lit(1).cast("bigint").alias("nv"),
        _one(F.col("real_time_voltage") > 230).alias("nv_v230"), health.alias("s_health"),
        _one(health.isNotNull()).alias("n_health"), eff.alias("s_eff"), _one(eff.isNotNull()).alias("n_eff"),
        _one(temp > 75).alias("nv_hot"))


def _one(cond: F.Column) -> F.Column:
    return F.coalesce(cond.cast("bigint"), F.lit(0).cast("bigint"))


def pair_sums(dispatch, device=None) -> dict[str, F.Column]:
    """Pair counts of a region-hour from both sides' sums; ``dispatch`` and ``device`` give a measure by name.
    Each is bilinear: linear in the one side's sums and in the other's."""
    d, v = dispatch, device or dispatch
    return {"pairs": d("nd") * v("nv"), "good_voltage": d("nd_kv600") * v("nv_v230"),
            "high_risk": d("nd_crit") * v("nv") + (d("nd") - d("nd_crit")) * v("nv_hot")}


def summary_of(j: DataFrame, places: int | None = None) -> DataFrame:
    """Summary rows from the sums of both sides and of their pairs. Means are rounded at ``places`` first, if given:
    exact sums meet halves that sums of doubles miss."""
    def mean(x):
        return R.r6(x if places is None else F.round(x, places))
    return j.select(
        F.concat(F.lit("SUMMARY_"), F.col("grid_region"), F.lit("_"), F.col("time_window")).alias("summary_id"),
        "grid_region", "time_window",
        F.col("nd").alias("total_dispatches"), F.col("nv").alias("total_devices"),
        mean(F.try_divide("s_bal", "n_bal")).alias("avg_supply_demand_balance"),
        R.r6(F.col("nd_stable") * 100.0 / F.col("nd")).alias("frequency_stability_rate"),
        R.r6(F.col("good_voltage") * 100.0 / F.col("pairs")).alias("voltage_quality_rate"),
        mean(F.try_divide("s_health", "n_health")).alias("avg_device_health"),
        mean(F.try_divide(F.col("s_ratio") * F.col("s_eff") * 100.0, F.col("n_ratio") * F.col("n_eff")))
        .alias("grid_efficiency_score"),
        F.col("high_risk").alias("high_risk_incidents"), F.col("nd_emerg").alias("emergency_responses"))


def grid_metrics_from_summary(summary: DataFrame, as_of: dt.datetime, hours: int = 2) -> DataFrame:
    """Region-hour summary of the last ``hours`` hours → monitoring metrics.

    online/offline use truncating casts, so they may not add up to the total
    (kept, SURVEY §2.13 #9)."""
    since = F.date_format(F.timestamp_add("HOUR", F.lit(-hours), ts_lit(as_of)), "yyyyMMddHH")
    s = summary.where(F.col("time_window") >= since)
    tot, rate = F.col("total_devices"), F.col("frequency_stability_rate")
    return s.select(
        F.concat(F.lit("GRID_METRICS_"), F.col("grid_region"), F.lit("_"), F.col("time_window"))
        .alias("metric_id"),
        "grid_region", tot.alias("total_devices"),
        (tot * rate / 100).cast("int").alias("online_devices"),
        (tot * (F.lit(100) - rate) / 100).cast("int").alias("offline_devices"),
        F.col("high_risk_incidents").alias("maintenance_devices"),
        F.col("avg_device_health").alias("avg_efficiency"),
        F.col("avg_supply_demand_balance").alias("avg_load_factor"),
        R.region_temperature_band(F.col("avg_device_health")).alias("avg_temperature"),
        F.col("emergency_responses").alias("alert_count"),
        ts_lit(as_of).alias("update_time"))


def smart_grid_report(summary: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Per region and hour report row from the summary (DDL-only table, formulas ours)."""
    h = F.col("avg_device_health")
    risky = F.col("high_risk_incidents") > 0
    return summary.select(
        F.concat(F.lit("REPORT_"), F.col("grid_region"), F.lit("_"), F.col("time_window")).alias("report_id"),
        F.lit(R.REPORT_TYPE).alias("report_type"), F.col("time_window").alias("analysis_period"),
        "grid_region",
        R.dround("frequency_stability_rate", 2).alias("grid_stability_index"),
        R.dround("grid_efficiency_score", 2).alias("operational_efficiency"),
        F.round(h.cast("decimal(28,6)") * F.lit(0.95).cast("decimal(3,2)"), 2).cast("double")
        .alias("energy_optimization_score"),
        R.reliability_rating(h / 100).alias("reliability_rating"),
        F.when(risky, R.RISK_MEDIUM).otherwise(R.RISK_LOW).alias("risk_assessment"),
        R.performance_trend(h / 100).alias("performance_trends"),
        F.when(risky, R.ADVICE_COOLING).otherwise(R.ADVICE_KEEP).alias("optimization_recommendations"),
        F.round(h.cast("decimal(28,6)") * 1500, 2).cast("double").alias("cost_benefit_analysis"),
        ts_lit(as_of).alias("report_time"))


# --------------------------------------------------- direct device → result path

def _status_row(devices: DataFrame, prefix: str, as_of: dt.datetime, load: F.Column,
                eff: F.Column, update_time: F.Column) -> DataFrame:
    return devices.select(
        F.concat(F.lit(prefix), F.col("device_id").cast("string"), F.lit("_"), epoch_text(as_of))
        .alias("summary_id"),
        "device_id", "device_type", "location",
        R.maintenance_to_status(F.col("maintenance_status")).alias("status"),
        load.alias("load_factor"), eff.alias("efficiency"),
        F.col("real_time_temperature").alias("temperature"), update_time.alias("update_time"))


def _load_guarded() -> F.Column:
    cap = F.col("capacity_mw")
    return F.when(cap > 0, F.col("real_time_current") / cap * 100).otherwise(F.lit(0.0))


def device_status_summary(devices: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Zero-capacity guarded load %, efficiency ×100, id CDC_<device>_<epoch>."""
    return _status_row(devices, "CDC_", as_of, _load_guarded(), F.col("efficiency_rate") * 100,
                       ts_lit(as_of))


def device_status_simple(devices: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Unguarded load % (NULL on zero capacity, where the reference divides by 0)."""
    load = R.safe_div(F.col("real_time_current"), F.col("capacity_mw")) * 100
    return _status_row(devices, "DEVICE_STATUS_", as_of, load, F.col("efficiency_rate") * 100,
                       F.col("installation_date"))


def device_status_sync(devices: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Database-side sync variant (SYNC_ ids), over all devices."""
    return _status_row(devices, "SYNC_", as_of, _load_guarded(), F.col("efficiency_rate") * 100,
                       ts_lit(as_of))


def device_status_capped(devices: DataFrame, as_of: dt.datetime) -> DataFrame:
    """LEAST(100, …) on load and efficiency."""
    cap = F.col("capacity_mw")
    load = F.when(cap > 0, F.least(F.lit(100.0), F.col("real_time_current") / cap * 100)) \
        .otherwise(F.lit(0.0))
    return _status_row(devices, REFRESH_PREFIX, as_of, load,
                       F.least(F.lit(100.0), F.col("efficiency_rate") * 100), ts_lit(as_of))


def _region_aggs(devices: DataFrame, capped: bool = False) -> DataFrame:
    cap = F.col("capacity_mw")
    load = F.col("real_time_current") / cap * 100
    if capped:
        load = F.least(F.lit(100.0), load)
    ms = F.col("maintenance_status")
    return devices.groupBy(R.region_prefix(F.col("location")).alias("grid_region")).agg(
        F.count(F.lit(1)).alias("total_devices"),
        R.count_if(ms == "NORMAL").alias("online_devices"),
        R.count_if(ms == "CRITICAL").alias("offline_devices"),
        R.count_if(ms == "MAINTENANCE").alias("maintenance_devices"),
        F.avg(F.col("efficiency_rate") * 100).alias("avg_efficiency"),
        F.avg(F.when(cap > 0, load).otherwise(F.lit(0.0))).alias("avg_load_factor"),
        F.avg("real_time_temperature").alias("avg_temperature"),
        R.count_if(F.col("real_time_temperature") > 70).alias("alert_count"))


def region_metrics(devices: DataFrame, as_of: dt.datetime) -> DataFrame:
    g = _region_aggs(devices)
    return g.select(
        F.concat(F.lit("CDC_"), F.col("grid_region"), F.lit("_"), epoch_text(as_of)).alias("metric_id"),
        "grid_region", "total_devices", "online_devices", "offline_devices", "maintenance_devices",
        R.r6("avg_efficiency").alias("avg_efficiency"), R.r6("avg_load_factor").alias("avg_load_factor"),
        R.r6("avg_temperature").alias("avg_temperature"), "alert_count",
        ts_lit(as_of).alias("update_time"))


def region_metrics_named(devices: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Prefix → grid company name (two prefixes may share a name, rows stay per
    prefix), ROUND 2, load capped at 100."""
    g = _region_aggs(devices, capped=True)
    return g.select(
        F.concat(F.lit(REFRESH_PREFIX), F.col("grid_region"), F.lit("_"), epoch_text(as_of)).alias("metric_id"),
        R.city_to_grid(F.col("grid_region")).alias("grid_region"),
        "total_devices", "online_devices", "offline_devices", "maintenance_devices",
        F.round("avg_efficiency", 2).alias("avg_efficiency"),
        F.round("avg_load_factor", 2).alias("avg_load_factor"),
        F.round("avg_temperature", 2).alias("avg_temperature"), "alert_count",
        ts_lit(as_of).alias("update_time"))


def region_report(devices: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Per region prefix: stability/efficiency (avg eff ×100), optimisation (×95),
    rating, risk, trend, advice, cost (×150000)."""
    eff = F.col("efficiency_rate")
    g = devices.groupBy(R.region_prefix(F.col("location")).alias("grid_region")).agg(
        F.avg(eff * 100).alias("gsi"), F.avg(eff * 95).alias("eos"), F.avg(eff).alias("ae"),
        F.avg("real_time_temperature").alias("at"), F.avg(eff * 150000).alias("cba"))
    return g.select(
        F.concat(F.lit("CDC_"), F.col("grid_region"), F.lit("_"), epoch_text(as_of)).alias("report_id"),
        F.lit(R.REPORT_TYPE).alias("report_type"),
        F.date_format(ts_lit(as_of), "yyyyMMddHH").alias("analysis_period"), "grid_region",
        R.r6("gsi").alias("grid_stability_index"), R.r6("gsi").alias("operational_efficiency"),
        R.r6("eos").alias("energy_optimization_score"),
        R.reliability_rating(F.col("ae")).alias("reliability_rating"),
        R.risk_assessment(F.col("at")).alias("risk_assessment"),
        R.performance_trend(F.col("ae")).alias("performance_trends"),
        R.advice(F.col("at")).alias("optimization_recommendations"),
        R.r6("cba").alias("cost_benefit_analysis"), ts_lit(as_of).alias("report_time"))


def region_report_extended(devices: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Adds the HIGH risk branch (> 3 CRITICAL devices), grid names, ROUND 2."""
    eff = F.col("efficiency_rate")
    g = devices.groupBy(R.region_prefix(F.col("location")).alias("prefix")).agg(
        F.avg(eff).alias("ae"), F.avg("real_time_temperature").alias("at"),
        R.count_if(F.col("maintenance_status") == "CRITICAL").alias("ncrit"))
    ae = F.col("ae")
    return g.select(
        F.concat(F.lit(REFRESH_PREFIX), F.col("prefix"), F.lit("_"), epoch_text(as_of)).alias("report_id"),
        F.lit(R.REPORT_TYPE).alias("report_type"),
        F.date_format(ts_lit(as_of), "yyyyMMddHH").alias("analysis_period"),
        R.city_to_grid(F.col("prefix")).alias("grid_region"),
        F.round(ae * 100, 2).alias("grid_stability_index"),
        F.round(ae * 100, 2).alias("operational_efficiency"),
        F.round(ae * 95, 2).alias("energy_optimization_score"),
        R.reliability_rating(ae).alias("reliability_rating"),
        R.risk_assessment(F.col("at"), F.col("ncrit")).alias("risk_assessment"),
        R.performance_trend(ae).alias("performance_trends"),
        R.advice(F.col("at"), F.col("ncrit")).alias("optimization_recommendations"),
        F.round(ae * 150000, 2).alias("cost_benefit_analysis"), ts_lit(as_of).alias("report_time"))


# ------------------------------------------------------- dashboard queries on results

def status_share(summary_rows: DataFrame) -> DataFrame:
    """status, count, ROUND(share %, 2); the denominator is the sum of the grouped rows (one per status)."""
    total = F.sum("device_count").over(Window.partitionBy())
    g = summary_rows.groupBy("status").agg(F.count(F.lit(1)).alias("device_count"))
    return g.select("status", "device_count",
                    F.round(F.col("device_count") * 100.0 / total, 2).alias("share_pct")) \
        .orderBy(F.col("device_count").desc())


def status_members(summary_rows: DataFrame) -> DataFrame:
    """string_agg(device_id) per status, ids in ascending order.

    The list of one status is a single value whose size grows with the data:
    use on bounded result tables only (not registered over whole tables)."""
    g = summary_rows.groupBy("status").agg(
        F.count(F.lit(1)).alias("device_count"),
        F.array_join(F.transform(F.sort_array(F.collect_list("device_id")), lambda x: x.cast("string")),
                     ", ").alias("device_list"))
    return g


def device_type_stats(summary_rows: DataFrame, online: str = "NORMAL") -> DataFrame:
    s = summary_rows.where(F.col("status") == online)
    return s.groupBy("device_type").agg(
        F.count(F.lit(1)).alias("device_count"),
        F.round(F.avg("efficiency"), 2).alias("avg_efficiency"),
        F.round(F.avg("load_factor"), 2).alias("avg_load_factor")).orderBy(F.col("device_count").desc())


def location_stats(summary_rows: DataFrame, online: str = "NORMAL") -> DataFrame:
    return summary_rows.groupBy("location").agg(
        F.count(F.lit(1)).alias("device_count"),
        F.round(F.avg(F.when(F.col("status") == online, F.col("efficiency"))), 2).alias("avg_efficiency"),
    ).orderBy(F.col("device_count").desc())


def _txt2(c: F.Column) -> F.Column:
    return F.round(c, 2).cast("decimal(18,2)").cast("string")


# Fixed metric labels of the device overview.
OVERVIEW_LABELS = ("设备总数", "平均效率", "平均负荷率", "平均温度")


def device_overview(summary_rows: DataFrame) -> DataFrame:
    """UNION ALL of text-valued metrics, from one scan."""
    one = summary_rows.agg(
        F.count(F.lit(1)).cast("string").alias("m0"),
        F.concat(_txt2(F.avg("efficiency")), F.lit("%")).alias("m1"),
        F.concat(_txt2(F.avg("load_factor")), F.lit("%")).alias("m2"),
        F.concat(F.round(F.avg("temperature"), 1).cast("decimal(18,1)").cast("string"), F.lit("°C")).alias("m3"))
    labels = F.create_map(*[x for i, lab in enumerate(OVERVIEW_LABELS) for x in (F.lit(f"m{i}"), F.lit(lab))])
    rows = one.unpivot([], ["m0", "m1", "m2", "m3"], "k", "metric_value")
    return rows.select(labels[F.col("k")].alias("metric"), "metric_value")


def flow_status_summary(status_rows: DataFrame, metric_rows: DataFrame, report_rows: DataFrame) -> DataFrame:
    """One row per result table: counts, two category counts, mean, newest time."""
    a = status_rows.agg(
        F.count(F.lit(1)).alias("record_count"),
        R.count_if(F.col("status") == "NORMAL").alias("m1"),
        R.count_if(F.col("status") == "CRITICAL").alias("m2"),
        F.round(F.avg("efficiency"), 2).alias("avg_value"),
        F.max("update_time").alias("latest_update")).select(F.lit("device_status").alias("data_type"), "*")
    b = metric_rows.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.sum("total_devices").cast("bigint").alias("m1"),
        F.sum("online_devices").cast("bigint").alias("m2"),
        F.round(F.avg("avg_efficiency"), 2).alias("avg_value"),
        F.max("update_time").alias("latest_update")).select(F.lit("grid_metrics").alias("data_type"), "*")
    c = report_rows.agg(
        F.count(F.lit(1)).alias("record_count"),
        R.count_if(F.col("reliability_rating").isin("A+", "A")).alias("m1"),
        R.count_if(F.col("reliability_rating").isin("B+", "B")).alias("m2"),
        F.round(F.avg("operational_efficiency"), 2).alias("avg_value"),
        F.max("report_time").alias("latest_update")).select(F.lit("grid_report").alias("data_type"), "*")
    return a.unionByName(b).unionByName(c)


# ------------------------------------------------------------ device reading rules

def device_raw(devices: DataFrame) -> DataFrame:
    """Device readings with the single-letter status of the raw-data table (A/M/O)."""
    ms = F.col("maintenance_status")
    return devices.select(
        "device_id", F.col("real_time_voltage").alias("voltage"),
        F.col("real_time_current").alias("current_val"),
        F.col("real_time_temperature").alias("temperature"),
        F.col("efficiency_rate").alias("efficiency"),
        F.when(ms == "MAINTENANCE", "M").when(ms == "CRITICAL", "O").otherwise("A").alias("status"),
        F.col("installation_date").alias("event_time"))


def abnormal_devices(raw: DataFrame) -> DataFrame:
    return raw.where((F.col("efficiency") < 0.90) | (F.col("status") != "A"))


def efficiency_grades(raw: DataFrame) -> DataFrame:
    return raw.groupBy(R.efficiency_grade(F.col("efficiency")).alias("grade")).agg(
        F.count(F.lit(1)).alias("device_count")).orderBy("grade")
