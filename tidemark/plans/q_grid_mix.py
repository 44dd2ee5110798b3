"""Registered pair-rule reports of the grid domain. The oracle forms every pair and
grades it; Spark counts bands."""

from __future__ import annotations

from tidemark.operators import grid as G
from tidemark.operators import grid_mix as M
from tidemark.plans import q_grid
from tidemark.plans.catalog import register

EPOCH = q_grid.EPOCH
CTES = dict(q_grid.CTES)
# Levels of every pair: how far up its scale each rule puts it.
CTES["r_levels"] = """SELECT dispatch_id, device_id, grid_region, strftime(d.event_time, '%Y%m%d%H') AS time_window,
    (round(frequency_hz * 10) BETWEEN 498 AND 502)::INT + (round(frequency_hz * 10) BETWEEN 499 AND 501)::INT AS f,
    (real_time_voltage > 220)::INT + (real_time_voltage > 230 AND voltage_level_kv > 600)::INT
        + (real_time_voltage > 240 AND voltage_level_kv > 750)::INT AS v,
    greatest(3 * (real_time_temperature > 75 OR emergency_level = 'CRITICAL')::INT,
        2 * (efficiency_rate < 0.85::DOUBLE OR emergency_level = 'HIGH')::INT, (load_balance_status <> 'BALANCED')::INT) AS k,
    (efficiency_rate > 0.85::DOUBLE)::INT AS e1, (efficiency_rate > 0.90::DOUBLE)::INT AS e2,
    (efficiency_rate > 0.95::DOUBLE)::INT AS e3
    FROM r_dispatch d, r_dev_ods v WHERE d.grid_region[:2] = v.location[:2]"""
CTES["r_graded"] = """SELECT *, e1 + (e2 = 1 AND f >= 1)::INT + (e3 = 1 AND f = 2)::INT AS o FROM r_levels"""


def _ods(c):
    return G.conform_dispatch(G.dispatch_source(c.dispatch)), G.conform_device(c.devices)


@register("grid_status_mix", sql="""WITH n AS (SELECT grid_region, time_window, f, v, k, o, count(*) AS n FROM r_graded GROUP BY ALL),
    l AS (SELECT grid_region, time_window, n, unnest([
        {'rule': 'frequency_stability', 'label': ['UNSTABLE', 'ACCEPTABLE', 'STABLE'][f + 1]},
        {'rule': 'voltage_quality', 'label': ['POOR', 'ACCEPTABLE', 'GOOD', 'EXCELLENT'][v + 1]},
        {'rule': 'risk_level', 'label': ['NORMAL', 'LOW_RISK', 'MEDIUM_RISK', 'HIGH_RISK'][k + 1]},
        {'rule': 'operational_status', 'label': ['NEEDS_ATTENTION', 'ACCEPTABLE', 'GOOD', 'OPTIMAL'][o + 1]},
        {'rule': 'dashboard_status', 'label': ['CRITICAL', 'WARNING', 'NORMAL', 'NORMAL'][o + 1]}]) AS r FROM n)
    SELECT grid_region, time_window, r.rule AS rule, r.label AS label, sum(n)::BIGINT AS pair_count FROM l GROUP BY ALL""",
          extra_ctes=CTES)
def q_grid_status_mix(c):
    return M.grid_status_mix(*_ods(c))


@register("dispatch_quality", sql="""WITH g AS (SELECT dispatch_id, count(*) AS paired_devices, max(f) AS f,
        count(*) FILTER (v = 3) AS excellent_devices, count(*) FILTER (v = 2) AS good_devices,
        count(*) FILTER (k = 3) AS high_risk_devices FROM r_graded GROUP BY dispatch_id)
    SELECT dispatch_id, grid_region, event_time, total_supply_mw - total_demand_mw AS supply_demand_balance,
    ['UNSTABLE', 'ACCEPTABLE', 'STABLE'][f + 1] AS frequency_stability, paired_devices, excellent_devices, good_devices,
    high_risk_devices FROM r_dispatch JOIN g USING (dispatch_id)""", extra_ctes=CTES)
def q_dispatch_quality(c):
    return M.dispatch_quality(*_ods(c))


# A score's band starts where it exceeds 70, 80, 90: base temperature, slope and the score the slope counts from.
@register("device_health", sql="""WITH h AS (SELECT device_id, device_type, location, 40 * efficiency_rate
        + 0.3::DOUBLE * (250 - real_time_temperature) + if(status = 'ACTIVE', 30, 10) AS h FROM r_dev_ods),
    b AS (SELECT *, 1 + (h > 70)::INT + (h > 80)::INT + (h > 90)::INT AS b FROM h)
    SELECT device_id, device_type, location, round(h, 6) AS device_health_score,
    round([65, 45, 35, 25][b] + [2, 4, 3, 2][b] * ([70, 80, 90, 100][b] - h), 6) AS temperature FROM b""", extra_ctes=CTES)
def q_device_health(c):
    return M.device_health(G.conform_device(c.devices))


@register("region_metrics_simple", sql=f"""SELECT concat_ws('_', 'GRID_METRICS', location[:2], '{EPOCH}') AS metric_id,
    location[:2] AS grid_region, count(*) AS total_devices, count(*) FILTER (maintenance_status = 'NORMAL') AS online_devices,
    count(*) FILTER (maintenance_status = 'CRITICAL') AS offline_devices,
    count(*) FILTER (maintenance_status = 'MAINTENANCE') AS maintenance_devices,
    round(100 * avg(efficiency_rate), 6) AS avg_efficiency,
    round(avg(100 * real_time_current / nullif(capacity_mw, 0)), 6) AS avg_load_factor,
    round(avg(real_time_temperature), 6) AS avg_temperature, count(*) FILTER (real_time_temperature > 70) AS alert_count,
    max(installation_date) AS update_time FROM r_devices GROUP BY location[:2]""")
def q_region_metrics_simple(c):
    return M.region_metrics_simple(c.devices, c.events_as_of)


@register("device_overview_by_state", sql="""WITH s AS (SELECT status, count(*) AS n, round(avg(efficiency), 2)::DECIMAL(18,2) AS e,
        round(avg(load_factor), 2)::DECIMAL(18,2) AS l FROM r_dss GROUP BY status)
    SELECT '设备总数' AS metric, sum(n)::BIGINT::VARCHAR AS metric_value FROM s
    UNION ALL SELECT x.metric, coalesce(max(n), 0)::VARCHAR FROM
        (VALUES ('在线设备', 'NORMAL'), ('离线设备', 'CRITICAL'), ('维护设备', 'MAINTENANCE')) x(metric, status)
        LEFT JOIN s USING (status) GROUP BY x.metric
    UNION ALL SELECT '平均效率', max(e)::VARCHAR || '%' FROM s WHERE status = 'NORMAL'
    UNION ALL SELECT '平均负荷', max(l)::VARCHAR || '%' FROM s WHERE status = 'NORMAL'""", extra_ctes=CTES)
def q_device_overview_by_state(c):
    return M.device_overview_by_state(G.device_status_summary(c.devices, c.events_as_of))
