"""Detail rules of dispatch x device pairs counted without forming a pair, and the
small device reports that go with them.

Every rule label of a pair depends on each side only through a band (a frequency class,
a voltage class, ...). Rows are therefore counted per band on either side first; a region
then has at most 54 dispatch bands an hour and 40 device bands, whatever the table sizes,
and one band pair stands for ``nd * nv`` detail rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.operators.grid import _txt2, epoch_text

RULES = ("frequency_stability", "voltage_quality", "risk_level", "operational_status", "dashboard_status")


def _level(value: F.Column, *thresholds: float) -> F.Column:
    """How many of the thresholds ``value`` exceeds; a NULL exceeds none."""
    return sum((F.coalesce((value > t).cast("int"), F.lit(0)) for t in thresholds), F.lit(0))


def _dispatch_bands(dispatch_ods: DataFrame) -> DataFrame:
    """Dispatches per region, hour and band; every column beside the count has one value a band as the rules see it."""
    em, bal, kv = F.col("emergency_level"), F.col("load_balance_status"), F.col("voltage_level_kv")
    return dispatch_ods.groupBy(
        R.region_prefix(F.col("grid_region")).alias("_p"), "grid_region",
        F.date_format("event_time", "yyyyMMddHH").alias("time_window"),
        R.frequency_stability(F.col("frequency_hz")).alias("frequency_stability"), _level(kv, 600, 750).alias("_kv"),
        F.when(em.isin("CRITICAL", "HIGH"), em).otherwise("NORMAL").alias("emergency_level"),
        F.when(bal != "BALANCED", "OTHER").otherwise("BALANCED").alias("load_balance_status"),
    ).agg(F.count(F.lit(1)).alias("nd"), F.max("frequency_hz").alias("frequency_hz"), F.max(kv).alias("voltage_level_kv"))


def _device_bands(device_ods: DataFrame) -> DataFrame:
    """Devices per region and band; a band's measures are those of one of its devices."""
    v, t, e = F.col("real_time_voltage"), F.col("real_time_temperature"), F.col("efficiency_rate")
    return device_ods.groupBy(
        R.region_prefix(F.col("location")).alias("_p"), _level(v, 220, 230, 240).alias("_v"), _level(t, 75).alias("_t"),
        _level(e, 0.85, 0.90, 0.95).alias("_e"), F.coalesce(e < 0.85, F.lit(False)).alias("_low"),
    ).agg(F.count(F.lit(1)).alias("nv"), F.max(v).alias("real_time_voltage"), F.max(t).alias("real_time_temperature"),
          F.max(e).alias("efficiency_rate"))


def grid_status_mix(dispatch_ods: DataFrame, device_ods: DataFrame) -> DataFrame:
    """Per (grid_region, hour, rule, label): how many detail rows carry that label of that rule.

    NULL measures fall to the branch the detail's CASE gives them; a region without devices has no rows."""
    eff, temp, freq = F.col("efficiency_rate"), F.col("real_time_temperature"), F.col("frequency_hz")
    j = _dispatch_bands(dispatch_ods).join(_device_bands(device_ods), "_p").select(
        "grid_region", "time_window", (F.col("nd") * F.col("nv")).alias("pairs"), "frequency_stability",
        R.voltage_quality(F.col("voltage_level_kv"), F.col("real_time_voltage")).alias("voltage_quality"),
        R.risk_level(F.col("emergency_level"), temp, eff, F.col("load_balance_status")).alias("risk_level"),
        R.operational_status(freq, eff).alias("operational_status"))
    j = j.withColumn("dashboard_status", R.dashboard_status(F.col("operational_status"), F.col("risk_level")))
    # a region-hour has few label combinations: they are counted before the rules are stacked
    combos = j.groupBy("grid_region", "time_window", *RULES).agg(F.sum("pairs").alias("pairs"))
    rows = combos.unpivot(["grid_region", "time_window", "pairs"], list(RULES), "rule", "label")
    return rows.groupBy("grid_region", "time_window", "rule", "label").agg(F.sum("pairs").alias("pair_count"))


def dispatch_quality(dispatch_ods: DataFrame, device_ods: DataFrame) -> DataFrame:
    """Per dispatch: balance, frequency label, and how many of its region's devices give an
    EXCELLENT or GOOD voltage and a HIGH_RISK pair. One row per region on the device side."""
    v, t = F.col("real_time_voltage"), F.col("real_time_temperature")
    per = device_ods.groupBy(R.region_prefix(F.col("location")).alias("_p")).agg(
        F.count(F.lit(1)).alias("nv"), R.count_if(v > 240).alias("n240"), R.count_if(v > 230).alias("n230"),
        R.count_if(t > 75).alias("n_hot"))
    kv = F.col("voltage_level_kv")
    d = dispatch_ods.withColumn("_p", R.region_prefix(F.col("grid_region"))).join(F.broadcast(per), "_p")  # one row a region prefix
    zero = F.lit(0).cast("bigint")
    excellent = F.when(kv > 750, F.col("n240")).otherwise(zero)
    return d.select(
        "dispatch_id", "grid_region", "event_time",
        (F.col("total_supply_mw") - F.col("total_demand_mw")).alias("supply_demand_balance"),
        R.frequency_stability(F.col("frequency_hz")).alias("frequency_stability"), F.col("nv").alias("paired_devices"),
        excellent.alias("excellent_devices"), (F.when(kv > 600, F.col("n230")).otherwise(zero) - excellent).alias("good_devices"),
        F.when(F.col("emergency_level") == "CRITICAL", F.col("nv")).otherwise(F.col("n_hot")).alias("high_risk_devices"))


def device_health(device_ods: DataFrame) -> DataFrame:
    """Per device: its health score and the temperature simulated from the score's band. Neither depends on
    the dispatch, so the pair rows of a device all carry these values."""
    h = R.device_health_score(F.col("efficiency_rate"), F.col("real_time_temperature"), F.col("status"))
    return device_ods.select("device_id", "device_type", "location", R.r6(h).alias("device_health_score"),
                             R.r6(R.temperature_from_health(h)).alias("temperature"))


def region_metrics_simple(devices: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Region metrics of the short flow: devices without capacity do not count in the load mean, and the
    update time is the newest installation date."""
    ms = F.col("maintenance_status")
    g = devices.groupBy(R.region_prefix(F.col("location")).alias("grid_region")).agg(
        F.count(F.lit(1)).alias("total_devices"),
        *[R.count_if(ms == s).alias(n) for s, n in [("NORMAL", "online_devices"), ("CRITICAL", "offline_devices"),
                                                    ("MAINTENANCE", "maintenance_devices")]],
        R.r6(F.avg(F.col("efficiency_rate") * 100)).alias("avg_efficiency"),
        R.r6(F.avg(F.try_divide("real_time_current", "capacity_mw") * 100)).alias("avg_load_factor"),
        R.r6(F.avg("real_time_temperature")).alias("avg_temperature"),
        R.count_if(F.col("real_time_temperature") > 70).alias("alert_count"),
        F.max("installation_date").alias("update_time"))
    key = F.concat(F.lit("GRID_METRICS_"), F.col("grid_region"), F.lit("_"), epoch_text(as_of))
    return g.select(key.alias("metric_id"), "*")


# Fixed metric labels of the overview by state.
STATE_LABELS = ("设备总数", "在线设备", "离线设备", "维护设备", "平均效率", "平均负荷")


def device_overview_by_state(summary_rows: DataFrame, online: str = "NORMAL", offline: str = "CRITICAL",
                             maintenance: str = "MAINTENANCE") -> DataFrame:
    """Six text-valued metrics from one scan: devices in all and per state, and the mean efficiency and
    load of the online ones (NULL where none is online)."""
    st = F.col("status")
    up = st == online
    values = [F.count(F.lit(1)).cast("string"), *[R.count_if(st == s).cast("string") for s in (online, offline, maintenance)],
              F.concat(_txt2(F.avg(F.when(up, F.col("efficiency")))), F.lit("%")),
              F.concat(_txt2(F.avg(F.when(up, F.col("load_factor")))), F.lit("%"))]
    one = summary_rows.agg(*[v.alias(f"m{i}") for i, v in enumerate(values)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("metric_value"))
                                         for i, n in enumerate(STATE_LABELS)])))
