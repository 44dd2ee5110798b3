"""Quality, latency and throughput monitors over the layers and result tables.

Monitors of the device-status sink count detail rows (dispatch × device
pairs). They are computed from per-region device counts: a dispatch in a
region stands for ``n_devices(region)`` sink rows, so no pair is formed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules as R

# Fixed labels of the layer-count monitors.
FLOW_SOURCE = "PostgreSQL源->CDC数据流"
FLOW_LAYERS = "数仓分层处理"
FLOW_SINK = "数仓->PostgreSQL sink数据流"
LAYER_ODS_DISPATCH = "ODS电力调度"
LAYER_ODS_DEVICE = "ODS设备维度"
LAYER_DWD = "DWD智能电网明细"
LAYER_DWS = "DWS电网运行汇总"
LAYER_ADS = "ADS综合分析报表"
SINK_REPORT = "Sink综合分析结果"
SINK_STATUS = "Sink设备状态汇总"
SINK_METRICS = "Sink电网监控指标"
MON_LATENCY = "CDC数据延迟监控"
MON_THROUGHPUT = "CDC数据吞吐量监控"
MON_INTEGRITY = "数据完整性监控"


ts_lit = R.ts_lit


def minus(as_of: dt.datetime, minutes: int) -> F.Column:
    return F.timestamp_add("MINUTE", F.lit(-minutes), ts_lit(as_of))


def _count_row(df: DataFrame, flow: str, layer: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("record_count")).select(
        F.lit(flow).alias("data_flow"), F.lit(layer).alias("layer"), "record_count")


def devices_per_region(device_ods: DataFrame) -> DataFrame:
    """One row per 2-character location prefix: number of devices."""
    return device_ods.groupBy(R.region_prefix(F.col("location")).alias("_p")).agg(
        F.count(F.lit(1)).alias("nv"))


def weighted_dispatch(dispatch_ods: DataFrame, device_ods: DataFrame, lo: F.Column) -> DataFrame:
    """Dispatches since ``lo``, each with the number of detail rows it produces."""
    d = dispatch_ods.where(F.col("event_time") >= lo).select(
        "dispatch_id", "event_time", R.region_prefix(F.col("grid_region")).alias("_p"))
    # one row a region prefix: the bound of what is broadcast; the dispatches stay where they are
    return d.join(F.broadcast(devices_per_region(device_ods)), "_p", "inner")


def _pairs_since(dispatch_ods, device_ods, lo) -> DataFrame:
    return weighted_dispatch(dispatch_ods, device_ods, lo).agg(
        F.coalesce(F.sum("nv"), F.lit(0)).cast("bigint").alias("record_count"))


def layer_row_counts(dispatch_ods: DataFrame, device_ods: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rows per layer: dispatches, devices and detail rows of the last ten minutes, region-hours of the last hour and
    report rows (one per region-hour). Either source is read once and reduced to a row per region prefix; a
    region-hour exists where its prefix has devices."""
    ten = F.col("event_time") >= minus(as_of, 10)
    hours = dispatch_ods.groupBy(
        R.region_prefix(F.col("grid_region")).alias("_p"), "grid_region",
        F.date_format("event_time", "yyyyMMddHH").alias("time_window")).agg(R.count_if(ten).alias("nd"))
    d = hours.groupBy("_p").agg(
        F.sum("nd").alias("nd"), F.count(F.lit(1)).alias("hours"),
        R.count_if(F.col("time_window") >= F.date_format(minus(as_of, 60), "yyyyMMddHH")).alias("recent_hours"))
    v = device_ods.groupBy(R.region_prefix(F.col("location")).alias("_p")).agg(
        F.count(F.lit(1)).alias("nv"), R.count_if(ten).alias("nv_ten"))
    paired = F.col("nv").isNotNull()
    layers = [(FLOW_SOURCE, LAYER_ODS_DISPATCH, F.col("nd")), (FLOW_SOURCE, LAYER_ODS_DEVICE, F.col("nv_ten")),
              (FLOW_LAYERS, LAYER_DWD, F.col("nd") * F.col("nv")), (FLOW_LAYERS, LAYER_DWS, F.when(paired, F.col("recent_hours"))),
              (FLOW_LAYERS, LAYER_ADS, F.when(paired, F.col("hours")))]
    one = d.join(v, "_p", "full_outer").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(f"n{i}") for i, (_, _, n) in enumerate(layers)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(flow).alias("data_flow"), F.lit(layer).alias("layer"), F.col(f"n{i}").alias("record_count"))
        for i, (flow, layer, _) in enumerate(layers)])))


def sink_row_counts(report_rows: DataFrame, status_rows: DataFrame, metric_rows: DataFrame,
                    as_of: dt.datetime) -> DataFrame:
    lo = minus(as_of, 60)
    return (_count_row(report_rows.where(F.col("report_time") >= lo), FLOW_SINK, SINK_REPORT)
            .unionByName(_count_row(status_rows.where(F.col("update_time") >= lo), FLOW_SINK, SINK_STATUS))
            .unionByName(_count_row(metric_rows.where(F.col("update_time") >= lo), FLOW_SINK, SINK_METRICS)))


def latency_stats(dispatch_ods: DataFrame, device_ods: DataFrame, as_of: dt.datetime,
                  minutes: int = 5) -> DataFrame:
    """avg / max / min seconds from detail-row update time to ``as_of`` over the
    last ``minutes`` (every sink row of a dispatch has the dispatch's time)."""
    w = weighted_dispatch(dispatch_ods, device_ods, minus(as_of, minutes))
    lag_us = F.unix_micros(F.to_timestamp(ts_lit(as_of))) - F.unix_micros(F.to_timestamp(F.col("event_time")))
    return w.agg(
        (F.sum(lag_us.cast("decimal(38,0)") * F.col("nv")).cast("double") / F.sum("nv") / F.lit(1e6)).alias("avg_delay_seconds"),
        (F.max(lag_us).cast("double") / F.lit(1e6)).alias("max_delay_seconds"),
        (F.min(lag_us).cast("double") / F.lit(1e6)).alias("min_delay_seconds"),
    ).select(F.lit(MON_LATENCY).alias("monitor_type"), "*")


def throughput_per_minute(dispatch_ods: DataFrame, device_ods: DataFrame, as_of: dt.datetime,
                          minutes: int = 10) -> DataFrame:
    w = weighted_dispatch(dispatch_ods, device_ods, minus(as_of, minutes))
    return w.groupBy(F.date_trunc("minute", F.col("event_time")).alias("time_minute")).agg(
        F.sum("nv").cast("bigint").alias("records_per_minute")
    ).select(F.lit(MON_THROUGHPUT).alias("monitor_type"), "time_minute", "records_per_minute") \
        .orderBy(F.col("time_minute").desc())


def layer_consistency(dispatch_ods: DataFrame, device_ods: DataFrame, sink: DataFrame, as_of: dt.datetime,
                      minutes: int = 5) -> DataFrame:
    """Four counts side by side. The detail's is dispatches times devices of each region; the sink's is what its
    written table says: ``sink`` holds (update_time, record_count), one row for each batch of rows written."""
    ten = F.col("event_time") >= minus(as_of, minutes)
    prefix = R.region_prefix
    d = dispatch_ods.groupBy(prefix(F.col("grid_region")).alias("_p")).agg(R.count_if(ten).alias("nd"))
    v = device_ods.groupBy(prefix(F.col("location")).alias("_p")).agg(
        F.count(F.lit(1)).alias("nv"), R.count_if(ten).alias("nv_new"))
    z = F.lit(0)
    ods = d.join(v, "_p", "full_outer").agg(
        F.coalesce(F.sum("nd"), z).cast("bigint").alias("ods_dispatch_count"),
        F.coalesce(F.sum("nv_new"), z).cast("bigint").alias("ods_device_count"),
        F.coalesce(F.sum(F.col("nd") * F.col("nv")), z).cast("bigint").alias("dwd_detail_count"))
    written = sink.where(F.col("update_time") >= minus(as_of, minutes)).select(
        F.coalesce(F.sum("record_count"), z).cast("bigint")).scalar()
    return ods.select(F.lit(MON_INTEGRITY).alias("monitor_type"), "*", written.alias("sink_summary_count"))


def recent_update_count(dispatch_ods: DataFrame, device_ods: DataFrame, as_of: dt.datetime,
                        minutes: int = 5) -> DataFrame:
    return _pairs_since(dispatch_ods, device_ods, minus(as_of, minutes)).withColumnRenamed(
        "record_count", "recent_updates")


def completeness(dmon: DataFrame) -> DataFrame:
    """Non-null counts per measure, per equipment."""
    return dmon.groupBy("equipment_id").agg(
        F.count(F.lit(1)).alias("total_records"), F.count("voltage_avg").alias("voltage_records"),
        F.count("current_avg").alias("current_records"), F.count("power_active").alias("power_records"))


def end_to_end_latency(dmon: DataFrame, as_of: dt.datetime, minutes: int = 10) -> DataFrame:
    """Per equipment: seconds from its newest reading of the last ``minutes`` to ``as_of``."""
    r = dmon.where(F.col("monitoring_time") >= minus(as_of, minutes))
    newest = F.max(F.unix_micros(F.to_timestamp(F.col("monitoring_time"))))
    return r.groupBy("equipment_id").agg(
        ((F.unix_micros(F.to_timestamp(ts_lit(as_of))) - newest).cast("double") / F.lit(1e6))
        .alias("latency_seconds"))


def source_sink_count_match(source: DataFrame, sink: DataFrame) -> DataFrame:
    s = source.select(F.count(F.lit(1))).scalar()
    k = sink.select(F.count(F.lit(1))).scalar()
    spark = source.sparkSession
    return spark.range(1).select(s.alias("source_count"), k.alias("sink_count"),
                                 ((s == k) & (s > 0)).alias("matched"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("row_count"))


def key_uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """Declared-but-unenforced keys: every key value held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)


def voltage_frequency_rules(dmon: DataFrame, as_of: dt.datetime, minutes: int = 10, n: int = 3) -> DataFrame:
    """Per reading of the last ``minutes``: voltage 200–240 and frequency
    49.5–50.5 rules; the newest ``n`` readings (top-k is the feature)."""
    r = dmon.where(F.col("monitoring_time") >= minus(as_of, minutes))
    return r.select(
        "monitoring_id", "equipment_id", "voltage_avg", "frequency",
        R.voltage_rule(F.col("voltage_avg")).alias("voltage_status"),
        R.frequency_rule(F.col("frequency")).alias("frequency_status"), "monitoring_time",
    ).orderBy(F.col("monitoring_time").desc(), F.col("monitoring_id").desc()).limit(n)
