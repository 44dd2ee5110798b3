"""Registered scenario queries and the top-k views (Spark job + DuckDB oracle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import equipment as E
from tidemark.operators import orders as O
from tidemark.operators import scenarios as S
from tidemark.plans import q_equipment
from tidemark.plans.catalog import register
from tidemark.plans.q_equipment import avg_half_up
from tidemark.plans.q_orders import DWD_ORDERS

TS = "TIMESTAMP '2024-01-30 23:59:59'"
CTES = dict(q_equipment.CTES)


@register("enrich_from_dimension", sql=f"""SELECT 'FINAL_' || location AS report_id,
    '{S.FINAL_REPORT_TYPE}' AS report_type, location, total_devices, score AS efficiency_score,
    CASE WHEN avg_t > 60 THEN 'WARNING' ELSE 'HEALTHY' END AS health_status,
    'high_temp=' || CAST(hot AS VARCHAR) || ';abnormal_voltage=' || CAST(badv AS VARCHAR) AS alert_summary,
    CASE WHEN score >= 90 THEN 'A' WHEN score >= 85 THEN 'B' ELSE 'C' END AS performance_grade,
    {TS} AS report_time
    FROM (SELECT location, COUNT(DISTINCT device_id) AS total_devices,
          {avg_half_up('efficiency_rate * 100', 2, 2)} AS score, AVG(temperature) AS avg_t,
          COUNT(CASE WHEN temperature > 70 THEN 1 END) AS hot,
          COUNT(CASE WHEN NOT (voltage BETWEEN 200 AND 240) THEN 1 END) AS badv
          FROM (SELECT m.equipment_id AS device_id, m.voltage_a AS voltage, m.temperature, d.location,
                d.efficiency_rate FROM r_monitoring m JOIN r_devices d ON m.equipment_id = d.device_id) j
          GROUP BY location) g""")
def q_enrich_from_dimension(c):
    """Scenario 1: the reading stream enriched by the device dimension."""
    readings = c.monitoring.select(F.col("equipment_id").alias("device_id"),
                                   F.col("voltage_a").alias("voltage"), "temperature")
    return S.enrich_from_dimension(readings, c.devices, c.events_as_of)


def _risk(x):
    return (f"CASE WHEN critical_devices > 0 AND temperature_anomaly > 0 THEN {x['HIGH']} "
            f"WHEN critical_devices > 0 OR temperature_anomaly > 0 THEN {x['MEDIUM']} ELSE {x['LOW']} END")


def _q(d):
    return {k: f"'{v}'" for k, v in d.items()}


ALARM_REPORT = f"""
    WITH m AS (SELECT a.alarm_id, r.temperature, r.power_factor FROM r_alarms a JOIN r_dmon r
               ON a.equipment_id = r.equipment_id
               AND r.monitoring_time BETWEEN a.occurred_at - INTERVAL 10 MINUTE AND a.occurred_at + INTERVAL 10 MINUTE),
    per AS (SELECT alarm_id, SUM(CAST(power_factor AS DECIMAL(18,4))) AS pf_sum, COUNT(power_factor) AS pf_n,
            COUNT(CASE WHEN temperature > 70 THEN 1 END) AS hot FROM m GROUP BY alarm_id),
    g AS (SELECT e.location, CAST(a.occurred_at AS DATE) AS day, COUNT(*) AS total_incidents,
          COUNT(DISTINCT CASE WHEN a.alarm_level >= 4 THEN a.equipment_id END) AS critical_devices,
          SUM(pf_sum) AS pf_sum, SUM(pf_n) AS pf_n, CAST(COALESCE(SUM(hot), 0) AS BIGINT) AS temperature_anomaly
          FROM r_alarms a LEFT JOIN per p ON a.alarm_id = p.alarm_id
          JOIN r_equipment e ON a.equipment_id = e.equipment_id
          GROUP BY e.location, CAST(a.occurred_at AS DATE))
    SELECT 'ALARM_' || location || '_' || strftime(day, '%Y%m%d') AS report_id,
        '{S.ALARM_REPORT_TYPE}' AS report_type, strftime(day, '%Y-%m-%d') AS time_period, location,
        total_incidents, critical_devices,
        round((1.0 - CAST((2 * CAST(pf_sum * 10000 AS HUGEINT) + pf_n) // NULLIF(2 * pf_n, 0) AS DOUBLE) / 10000) * 100, 2)
            AS efficiency_impact,
        temperature_anomaly, {_risk(_q({'HIGH': 'HIGH', 'MEDIUM': 'MEDIUM', 'LOW': 'LOW'}))} AS risk_assessment,
        {_risk(_q(S.ACTIONS))} AS suggested_actions, {_risk(_q(S.PRIORITY))} AS priority_level,
        {TS} AS report_time FROM g"""


@register("alarm_status_join", sql=ALARM_REPORT, extra_ctes=CTES)
def q_alarm_status_join(c):
    """Scenario 2: alarm stream ⋈ device status stream within ±10 minutes."""
    return S.alarm_status_join(c.alarms, E.reading_facts(c.monitoring), c.equipment, c.events_as_of, 10)


CAUSE = "CASE " + " ".join(f"WHEN alarm_type = '{k}' THEN '{v}'" for k, v in S.ROOT_CAUSE) + " ELSE '其他' END"


@register("fault_analysis", sql=f"""
    WITH f AS (SELECT * FROM r_alarms WHERE alarm_level >= 4),
    m AS (SELECT f.alarm_id, f.occurred_at, r.monitoring_time, r.power_active FROM f JOIN r_monitoring r
          ON f.equipment_id = r.equipment_id
          AND r.monitoring_time BETWEEN f.occurred_at - INTERVAL 60 MINUTE AND f.occurred_at),
    per AS (SELECT alarm_id,
            {avg_half_up('CASE WHEN monitoring_time < occurred_at THEN power_active END', 2, 4)} AS pre,
            arg_max(power_active, monitoring_time) AS at_fault FROM m GROUP BY alarm_id)
    SELECT 'FAULT_' || CAST(f.alarm_id AS VARCHAR) AS analysis_id, f.equipment_id AS device_id,
        '{S.FAULT_ANALYSIS_TYPE}' AS analysis_type, strftime(f.occurred_at, '%Y%m%d%H') AS fault_time_period,
        pre AS pre_fault_performance,
        'level=' || CAST(alarm_level AS VARCHAR) || ';code=' || alarm_code AS fault_indicators,
        {CAUSE} AS root_cause_analysis,
        round((pre - at_fault) / NULLIF(pre, 0) * 100, 2) AS performance_degradation,
        CASE WHEN alarm_level >= 5 THEN '{S.RECOVERY['URGENT']}' ELSE '{S.RECOVERY['HIGH']}' END AS recovery_suggestions,
        CASE WHEN alarm_level >= 5 THEN 'URGENT' ELSE 'HIGH' END AS maintenance_priority,
        {TS} AS analysis_time
    FROM f LEFT JOIN per ON f.alarm_id = per.alarm_id""")
def q_fault_analysis(c):
    """Scenario 3: device history before each fault (as-of reading, pre-fault mean)."""
    return S.fault_analysis(c.alarms, c.monitoring, c.events_as_of)


@register("recent_alarms", sql="""SELECT alarm_id, equipment_id, alarm_type, alarm_level, alarm_message,
    occurred_at FROM r_alarms ORDER BY occurred_at DESC, alarm_id DESC LIMIT 5""")
def q_recent_alarms(c):
    """Newest five alarms (top-k is the feature)."""
    return (c.alarms.select("alarm_id", "equipment_id", "alarm_type", "alarm_level", "alarm_message",
                            "occurred_at")
            .orderBy(F.col("occurred_at").desc(), F.col("alarm_id").desc()).limit(5))


@register("recent_dashboard", sql=f"""SELECT * FROM (
    SELECT 'total_orders' AS metric_name, CAST(COUNT(*) AS DOUBLE) AS metric_value FROM r_dorders
    UNION ALL SELECT 'total_sales', COALESCE(CAST(SUM(order_amount) AS DOUBLE), 0) FROM r_dorders
        WHERE order_status = 'completed'
    UNION ALL SELECT 'avg_order_value', COALESCE(CAST(SUM(order_amount) AS DOUBLE) / COUNT(order_amount), 0)
        FROM r_dorders WHERE order_status = 'completed'
    UNION ALL SELECT 'today_orders', CAST(COUNT(*) AS DOUBLE) FROM r_dorders
        WHERE CAST(created_at AS DATE) = DATE '2001-08-01'
    UNION ALL SELECT 'today_sales', COALESCE(CAST(SUM(order_amount) AS DOUBLE), 0) FROM r_dorders
        WHERE CAST(created_at AS DATE) = DATE '2001-08-01' AND order_status = 'completed'
    UNION ALL SELECT 'total_users', CAST(COUNT(DISTINCT id) AS DOUBLE) FROM r_users) d
    ORDER BY metric_name LIMIT 10""", extra_ctes={"r_dorders": DWD_ORDERS})
def q_recent_dashboard(c):
    """Newest ten dashboard metric rows (all rows share one update time, so
    metric_name orders them deterministically)."""
    d = O.realtime_dashboard(O.dwd_users(c.users, c.orders_as_of), O.order_facts(c.orders), c.orders_as_of)
    return d.orderBy(F.col("update_time").desc(), "metric_name").limit(10).select("metric_name", "metric_value")
