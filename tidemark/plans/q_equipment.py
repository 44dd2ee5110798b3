"""Registered equipment-monitoring queries (Spark job + DuckDB oracle)."""

from __future__ import annotations

from tidemark.operators import equipment as E
from tidemark.plans.catalog import register

TS = "TIMESTAMP '2024-01-30 23:59:59'"


def _case(col, pairs, default=None):
    body = " ".join(f"WHEN {col} = {k!r} THEN '{v}'" if isinstance(k, str) else f"WHEN {col} = {k} THEN '{v}'"
                    for k, v in pairs)
    return f"CASE {body}" + (f" ELSE '{default}'" if default else "") + " END"


VCODE = "CAST(regexp_extract(voltage_level, '^([0-9]+)', 1) AS INTEGER)"
def avg_half_up(x: str, in_scale: int, out_scale: int) -> str:
    """ROUND(AVG(x), out_scale) on the exact mean (HALF_UP, non-negative x),
    in integer arithmetic: the oracle twin of ``rules.avg_round``."""
    units = f"CAST(round(SUM(CAST({x} AS DECIMAL(18,{in_scale}))) * {10 ** in_scale}) AS HUGEINT)"
    num = f"(2 * {units} * {10 ** (out_scale - in_scale)} + COUNT({x}))"
    return f"CAST({num} // NULLIF(2 * COUNT({x}), 0) AS DOUBLE) / {10 ** out_scale}"


V_LO, V_HI = 220.0 * (1 - 0.07), 220.0 * (1 + 0.07)

CTES = {
    "r_dequip": f"""SELECT equipment_id, equipment_name, equipment_type,
        {_case('equipment_type', E.TYPE_CODES, 'OT')} AS equipment_type_code, location,
        substring(location, 1, 2) AS province, substring(location, 1, 2) AS city,
        CASE WHEN length(location) > 2 THEN substring(location, 3) END AS district,
        voltage_level, {VCODE} AS voltage_level_code, capacity_mw,
        CASE WHEN capacity_mw < 100 THEN '{E.CAPACITY_LEVELS[0]}' WHEN capacity_mw < 250
             THEN '{E.CAPACITY_LEVELS[1]}' ELSE '{E.CAPACITY_LEVELS[2]}' END AS capacity_level,
        installation_date, year(installation_date) AS installation_year, last_maintenance_date,
        date_diff('day', installation_date, last_maintenance_date) AS maintenance_interval_days,
        status, ({VCODE} >= 220 OR capacity_mw >= 250) AS is_critical FROM r_equipment""",
    "r_dmon": """SELECT monitoring_id, equipment_id, equipment_name, equipment_type,
        voltage_a, voltage_b, voltage_c, round(va, 2) AS voltage_avg,
        round(greatest(abs(voltage_a - va), abs(voltage_b - va), abs(voltage_c - va)) / NULLIF(va, 0), 4) AS voltage_imbalance,
        current_a, current_b, current_c, round(ca, 2) AS current_avg,
        round(greatest(abs(current_a - ca), abs(current_b - ca), abs(current_c - ca)) / NULLIF(ca, 0), 4) AS current_imbalance,
        power_active, power_reactive, round(power_active / NULLIF(s, 0), 4) AS power_factor,
        round(s, 2) AS power_apparent, frequency, round(frequency - 50, 4) AS frequency_deviation,
        temperature, humidity, CAST(monitoring_time AS DATE) AS monitoring_date,
        hour(monitoring_time) AS monitoring_hour, minute(monitoring_time) AS monitoring_minute,
        (hour(monitoring_time) BETWEEN 8 AND 11 OR hour(monitoring_time) BETWEEN 17 AND 21) AS is_peak_hour,
        isodow(monitoring_time) <= 5 AS is_working_day, monitoring_time
        FROM (SELECT m.*, e.equipment_name, e.equipment_type,
              (voltage_a + voltage_b + voltage_c) / 3 AS va, (current_a + current_b + current_c) / 3 AS ca,
              sqrt(power_active * power_active + power_reactive * power_reactive) AS s
              FROM r_monitoring m LEFT JOIN r_equipment e ON m.equipment_id = e.equipment_id) x""",
    "r_dalarms": f"""SELECT a.alarm_id, a.equipment_id, e.equipment_name, e.equipment_type, a.alarm_type,
        a.alarm_level, {_case('a.alarm_level', E.LEVEL_NAMES)} AS alarm_level_name, a.alarm_message,
        a.alarm_code, {_case('a.alarm_type', E.ALARM_CATEGORIES, '其他')} AS alarm_category, a.is_resolved,
        CAST(date_sub('minute', a.occurred_at, a.resolved_at) AS INTEGER) AS resolution_time_minutes,
        CAST(a.occurred_at AS DATE) AS occurred_date, hour(a.occurred_at) AS occurred_hour,
        a.occurred_at, a.resolved_at
        FROM r_alarms a LEFT JOIN r_equipment e ON a.equipment_id = e.equipment_id""",
    "r_latest": f"""WITH newest AS (SELECT equipment_id, voltage_avg, current_avg, power_active, power_factor, frequency,
            temperature, monitoring_time FROM r_dmon
            QUALIFY rank() OVER (PARTITION BY equipment_id ORDER BY monitoring_time DESC) = 1)
        SELECT equipment_id, equipment_name, equipment_type, location, voltage_level, capacity_mw, status,
        newest.* EXCLUDE (equipment_id),
        ['OFFLINE', 'ONLINE'][1 + (epoch_us({TS}) - epoch_us(monitoring_time) < 600000000)::INT] AS connection_status
        FROM newest JOIN r_dequip USING (equipment_id)""",
}


def _dequip(c):
    return E.dwd_power_equipment(c.equipment)


def _dmon(c):
    return E.dwd_power_monitoring(c.monitoring, c.equipment)


def _mfacts(c):
    return E.reading_facts(c.monitoring)


def _afacts(c):
    return E.alarm_facts(c.alarms)


def _dalarms(c):
    return E.dwd_equipment_alarms(c.alarms, c.equipment)


def _latest(c):
    return E.latest_status(_dequip(c), _mfacts(c), c.events_as_of)


@register("dwd_power_equipment", sql="SELECT * FROM r_dequip", extra_ctes=CTES)
def q_dwd_power_equipment(c):
    return _dequip(c)


@register("dwd_power_monitoring", sql="SELECT * FROM r_dmon", extra_ctes=CTES)
def q_dwd_power_monitoring(c):
    return _dmon(c)


@register("dwd_equipment_alarms", sql="SELECT * FROM r_dalarms", extra_ctes=CTES)
def q_dwd_equipment_alarms(c):
    return _dalarms(c)


@register("latest_status", sql="SELECT * FROM r_latest", extra_ctes=CTES)
def q_latest_status(c):
    return _latest(c)


@register("alarm_statistics", sql="""WITH a AS (SELECT equipment_type, alarm_type, alarm_level, count(*) AS total_count,
        sum(is_resolved::INT)::BIGINT AS resolved_count, avg(resolution_time_minutes) AS avg_resolution_time
        FROM r_dalarms WHERE occurred_date >= DATE '2023-12-31' GROUP BY ALL)
    SELECT *, total_count - resolved_count AS unresolved_count FROM a""", extra_ctes=CTES)
def q_alarm_statistics(c):
    return E.alarm_statistics(_dalarms(c), c.events_as_of)


DAILY_SUMMARY = f"""SELECT
    g.equipment_id * 100000 + date_diff('day', DATE '1970-01-01', g.summary_date) AS summary_id,
    g.equipment_id, g.equipment_name, g.equipment_type, g.summary_date, voltage_avg, voltage_max,
    voltage_min, voltage_std, current_avg, current_max, current_min, power_active_avg,
    power_active_max, power_active_min, power_factor_avg, frequency_avg, temperature_avg,
    temperature_max, monitoring_count, abnormal_count, uptime_hours,
    round((p_sum / p_n) / NULLIF(c.capacity_mw, 0), 4) AS utilization_rate
    FROM (SELECT equipment_id, equipment_name, equipment_type, monitoring_date AS summary_date,
        {avg_half_up('voltage_avg', 2, 2)} AS voltage_avg, MAX(voltage_avg) AS voltage_max,
        MIN(voltage_avg) AS voltage_min, round(stddev_samp(voltage_avg), 4) AS voltage_std,
        {avg_half_up('current_avg', 2, 2)} AS current_avg, MAX(current_avg) AS current_max,
        MIN(current_avg) AS current_min, {avg_half_up('power_active', 2, 2)} AS power_active_avg,
        MAX(power_active) AS power_active_max, MIN(power_active) AS power_active_min,
        {avg_half_up('power_factor', 4, 4)} AS power_factor_avg, {avg_half_up('frequency', 2, 3)} AS frequency_avg,
        {avg_half_up('temperature', 2, 2)} AS temperature_avg, MAX(temperature) AS temperature_max,
        CAST(COUNT(*) AS BIGINT) AS monitoring_count,
        CAST(COUNT(CASE WHEN NOT (voltage_avg BETWEEN 200 AND 240) OR NOT (frequency BETWEEN 49.5 AND 50.5)
             THEN 1 END) AS BIGINT) AS abnormal_count,
        CAST(COUNT(DISTINCT monitoring_hour) AS DOUBLE) AS uptime_hours,
        SUM(power_active) AS p_sum, COUNT(power_active) AS p_n
        FROM r_dmon GROUP BY equipment_id, equipment_name, equipment_type, monitoring_date) g
    LEFT JOIN r_equipment c ON g.equipment_id = c.equipment_id"""


@register("equipment_daily_summary", sql=DAILY_SUMMARY, extra_ctes=CTES)
def q_equipment_daily_summary(c):
    return E.equipment_daily_summary(_mfacts(c), c.equipment)


@register("alarm_daily_summary", sql="""SELECT occurred_date AS summary_date, equipment_type,
    alarm_type, alarm_level, CAST(COUNT(*) AS BIGINT) AS total_alarms,
    CAST(COUNT(CASE WHEN is_resolved THEN 1 END) AS BIGINT) AS resolved_alarms,
    CAST(COUNT(CASE WHEN NOT is_resolved THEN 1 END) AS BIGINT) AS unresolved_alarms,
    round(AVG(resolution_time_minutes), 2) AS avg_resolution_time_minutes,
    MAX(resolution_time_minutes) AS max_resolution_time_minutes,
    CAST(COUNT(CASE WHEN alarm_level >= 4 THEN 1 END) AS BIGINT) AS critical_alarms,
    CAST(COUNT(CASE WHEN alarm_level IN (2, 3) THEN 1 END) AS BIGINT) AS warning_alarms,
    CAST(COUNT(CASE WHEN alarm_level = 1 THEN 1 END) AS BIGINT) AS info_alarms
    FROM r_dalarms GROUP BY occurred_date, equipment_type, alarm_type, alarm_level""", extra_ctes=CTES)
def q_alarm_daily_summary(c):
    return E.alarm_daily_summary(_dalarms(c))


@register("equipment_dashboard", sql=f"""SELECT 20240130 AS dashboard_id,
    CAST(total_equipment AS BIGINT) AS total_equipment, CAST(online_equipment AS BIGINT) AS online_equipment,
    CAST(offline_equipment AS BIGINT) AS offline_equipment,
    CAST(maintenance_equipment AS BIGINT) AS maintenance_equipment,
    round(total_capacity_mw, 2) AS total_capacity_mw, round(active_capacity_mw, 2) AS active_capacity_mw,
    round(active_power / NULLIF(active_capacity_mw, 0), 4) AS load_rate,
    CAST(total_active_alarms AS BIGINT) AS total_active_alarms,
    CAST(critical_alarms AS BIGINT) AS critical_alarms, CAST(warning_alarms AS BIGINT) AS warning_alarms,
    round(avg_voltage_220kv, 2) AS avg_voltage_220kv, round(avg_voltage_110kv, 2) AS avg_voltage_110kv,
    round(avg_frequency, 3) AS avg_frequency,
    CASE WHEN critical_alarms > 0 THEN '{E.SYSTEM_STATUS[2]}' WHEN total_active_alarms > 0
         THEN '{E.SYSTEM_STATUS[1]}' ELSE '{E.SYSTEM_STATUS[0]}' END AS system_status,
    {TS} AS last_updated
    FROM (SELECT COUNT(*) AS total_equipment,
            COUNT(CASE WHEN status = 'ACTIVE' THEN 1 END) AS online_equipment,
            COUNT(CASE WHEN status = 'INACTIVE' THEN 1 END) AS offline_equipment,
            COUNT(CASE WHEN status = 'MAINTENANCE' THEN 1 END) AS maintenance_equipment,
            SUM(capacity_mw) AS total_capacity_mw,
            COALESCE(SUM(CASE WHEN status = 'ACTIVE' THEN capacity_mw END), 0) AS active_capacity_mw
          FROM r_dequip) e,
         (SELECT COUNT(CASE WHEN NOT is_resolved THEN 1 END) AS total_active_alarms,
            COUNT(CASE WHEN NOT is_resolved AND alarm_level >= 4 THEN 1 END) AS critical_alarms,
            COUNT(CASE WHEN NOT is_resolved AND alarm_level IN (2, 3) THEN 1 END) AS warning_alarms
          FROM r_dalarms) a,
         (SELECT SUM(CASE WHEN status = 'ACTIVE' THEN power_active END) AS active_power,
            AVG(CASE WHEN voltage_level = '220kV' THEN voltage_avg END) AS avg_voltage_220kv,
            AVG(CASE WHEN voltage_level = '110kV' THEN voltage_avg END) AS avg_voltage_110kv,
            AVG(frequency) AS avg_frequency
          FROM r_latest) r""", extra_ctes=CTES)
def q_equipment_dashboard(c):
    return E.equipment_dashboard(_dequip(c), _afacts(c), _latest(c), c.events_as_of)


@register("power_quality", sql=f"""SELECT CAST(strftime(analysis_date, '%Y%m%d') AS BIGINT) AS analysis_id,
    analysis_date, round(vq, 4) AS voltage_qualification_rate, round(fq, 4) AS frequency_qualification_rate,
    round(pf, 4) AS power_factor_avg, round(vi, 4) AS voltage_imbalance_rate,
    round(ci, 4) AS current_imbalance_rate, CAST(NULL AS DOUBLE) AS harmonic_distortion_rate,
    score AS power_quality_score,
    CASE WHEN score >= 90 THEN '{E.QUALITY_LEVELS[0]}' WHEN score >= 80 THEN '{E.QUALITY_LEVELS[1]}'
         WHEN score >= 60 THEN '{E.QUALITY_LEVELS[2]}' ELSE '{E.QUALITY_LEVELS[3]}' END AS quality_level
    FROM (SELECT *, round((vq * 0.4 + fq * 0.4 + COALESCE(pf, 0.0) * 0.2) * 100, 2) AS score
      FROM (SELECT monitoring_date AS analysis_date,
        CAST(COUNT(CASE WHEN voltage_avg BETWEEN {V_LO!r} AND {V_HI!r} THEN 1 END) AS DOUBLE) / COUNT(*) AS vq,
        CAST(COUNT(CASE WHEN abs(frequency - 50) <= 0.2 THEN 1 END) AS DOUBLE) / COUNT(*) AS fq,
        AVG(power_factor) AS pf,
        CAST(COUNT(CASE WHEN voltage_imbalance > 0.02 THEN 1 END) AS DOUBLE) / COUNT(*) AS vi,
        CAST(COUNT(CASE WHEN current_imbalance > 0.02 THEN 1 END) AS DOUBLE) / COUNT(*) AS ci
        FROM r_dmon GROUP BY monitoring_date) g) s""", extra_ctes=CTES)
def q_power_quality(c):
    return E.power_quality(_mfacts(c))


@register("equipment_health", sql=f"""SELECT equipment_id * 100000 + 19752 AS assessment_id,
    equipment_id, equipment_name, equipment_type, score AS health_score,
    CASE WHEN score >= 85 THEN '{E.HEALTH_LEVELS[0]}' WHEN score >= 70 THEN '{E.HEALTH_LEVELS[1]}'
         WHEN score >= 50 THEN '{E.HEALTH_LEVELS[2]}' ELSE '{E.HEALTH_LEVELS[3]}' END AS health_level,
    round(COALESCE(n_resolved * 100.0::DOUBLE / n_alarms, 100.0), 2) AS reliability_score,
    CASE WHEN score < 50 THEN 5 WHEN score < 70 THEN 4 WHEN score < 85 THEN 3 WHEN score < 95 THEN 2
         ELSE 1 END AS maintenance_urgency,
    round(1.0 - score / 100, 4) AS predicted_failure_probability,
    CAST(trunc(score * 36.5) AS INTEGER) AS remaining_life_days,
    CASE WHEN score >= 85 THEN '{E.HEALTH_ADVICE[0]}' WHEN score >= 70 THEN '{E.HEALTH_ADVICE[1]}'
         WHEN score >= 50 THEN '{E.HEALTH_ADVICE[2]}' ELSE '{E.HEALTH_ADVICE[3]}' END AS maintenance_recommendation,
    DATE '2024-01-30' AS assessment_date
    FROM (SELECT e.equipment_id, e.equipment_name, e.equipment_type, n_alarms, n_resolved,
        round(greatest(0.0, 100.0 - COALESCE(CAST(n_open AS DOUBLE) / n_alarms, 0.0) * 50
              - COALESCE(CAST(n_open_crit AS DOUBLE) / n_alarms, 0.0) * 30
              - greatest(0.0, COALESCE(avg_temp, 0.0) - 60)), 2) AS score
      FROM r_dequip e
      LEFT JOIN (SELECT equipment_id AS a_eid, COUNT(*) AS n_alarms,
            COUNT(CASE WHEN NOT is_resolved THEN 1 END) AS n_open,
            COUNT(CASE WHEN NOT is_resolved AND alarm_level >= 4 THEN 1 END) AS n_open_crit,
            COUNT(CASE WHEN is_resolved THEN 1 END) AS n_resolved
            FROM r_dalarms GROUP BY equipment_id) a ON e.equipment_id = a.a_eid
      LEFT JOIN (SELECT equipment_id AS m_eid, AVG(temperature) AS avg_temp FROM r_dmon
            GROUP BY equipment_id) t ON e.equipment_id = t.m_eid) s""", extra_ctes=CTES)
def q_equipment_health(c):
    return E.equipment_health(_dequip(c), _mfacts(c), _afacts(c), c.events_as_of)


@register("columnar_report", sql="""SELECT equipment_id, CAST(monitoring_time AS DATE) AS report_date,
    COUNT(*) AS readings, round(AVG(power_active), 6) AS avg_power_active,
    round(AVG(temperature), 6) AS avg_temperature
    FROM r_monitoring GROUP BY equipment_id, CAST(monitoring_time AS DATE)""")
def q_columnar_report(c):
    return E.columnar_report(c.monitoring)
