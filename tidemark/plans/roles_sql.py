"""The role bindings of ``tidemark.sources.bind`` written as DuckDB SQL.

Used only by the oracle: every oracle query is a ``WITH`` over the roles it
names (``r_users``, ``r_orders`` ...), so each query is checked against an
independent SQL formulation over the same parquet tables.
"""

from __future__ import annotations

import re

ROLE_SQL: dict[str, str] = {
    "r_users": """SELECT c_custkey AS id, c_name AS username,
        c_name || '@' || lower(c_mktsegment) AS email,
        TIMESTAMP '1995-01-01' AS created_at, TIMESTAMP '1995-01-01' AS updated_at
        FROM customer""",
    "r_orders": """SELECT o_orderkey AS id, o_custkey AS user_id,
        CAST(o_totalprice AS DECIMAL(12,2)) AS order_amount,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
             ELSE 'cancelled' END AS order_status,
        o_orderdate AS created_at, o_orderdate AS updated_at
        FROM orders""",
    "r_items": """SELECT l_orderkey AS order_id, l_linenumber, l_partkey AS item_partkey,
        l_suppkey AS item_suppkey, p_name AS product_name,
        CAST(l_quantity AS INTEGER) AS quantity,
        CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price, l_shipdate AS created_at
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "r_agents": """SELECT s_suppkey AS agent_id, s_name AS agent_name, n_name AS department,
        CASE WHEN s_acctbal >= 0 THEN 'online' ELSE 'offline' END AS status
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "r_tickets": """SELECT event_id AS ticket_id, user_id AS customer_id,
        CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS agent_id,
        event_type || ' #' || CAST(event_id AS VARCHAR) AS title,
        CASE WHEN value >= 100 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'low' END AS priority,
        CASE event_type WHEN 'view' THEN 'in_progress' WHEN 'purchase' THEN 'resolved'
             WHEN 'error' THEN 'closed' ELSE 'pending' END AS status,
        event_type AS category,
        ts AS created_at,
        ts + to_minutes(CAST(floor(value) AS BIGINT)) AS updated_at,
        CASE WHEN event_type IN ('purchase', 'error')
             THEN ts + to_minutes(CAST(floor(value * 10) AS BIGINT)) END AS closed_at
        FROM events""",
    "r_logs": """SELECT event_id AS log_id, event_id - event_id % 4 AS ticket_id,
        user_id AS agent_id, event_type AS action, 'pending' AS old_value,
        CASE event_type WHEN 'view' THEN 'in_progress' WHEN 'purchase' THEN 'resolved'
             WHEN 'error' THEN 'closed' ELSE 'pending' END AS new_value,
        props AS comment, ts AS created_at
        FROM events""",
    "r_devices": """SELECT s_suppkey AS device_id, s_name AS device_name,
        CASE s_suppkey % 6 WHEN 0 THEN '变压器' WHEN 1 THEN '发电机' WHEN 2 THEN '输电线路'
             WHEN 3 THEN '配电设备' WHEN 4 THEN '开关设备' ELSE '继电保护' END AS device_type,
        r_name AS location, greatest(s_acctbal, 0) AS capacity_mw,
        TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey % 3000 AS INTEGER)) AS installation_date,
        0.80::DOUBLE + (s_suppkey % 19) / 100.0::DOUBLE AS efficiency_rate,
        CASE s_suppkey % 4 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'MAINTENANCE'
             ELSE 'CRITICAL' END AS maintenance_status,
        210.0::DOUBLE + s_suppkey % 40 AS real_time_voltage,
        50.0::DOUBLE + s_suppkey % 150 AS real_time_current,
        20.0::DOUBLE + s_suppkey % 60 AS real_time_temperature
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "r_dispatch": """SELECT event_id AS dispatch_id, ts AS event_time, r_name AS grid_region,
        15000.0::DOUBLE + (event_id % 97) * 100 AS total_demand_mw,
        15000.0::DOUBLE + value * 20 AS total_supply_mw,
        (497 + event_id % 7) / 10.0::DOUBLE AS frequency_hz,
        580.0::DOUBLE + event_id % 200 AS voltage_level_kv,
        CASE WHEN event_id % 3 = 0 THEN 'BALANCED' ELSE 'STRESSED' END AS load_balance_status,
        CASE event_id % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'NORMAL' END AS emergency_level
        FROM events JOIN region ON user_id % 5 = r_regionkey""",
    "r_changes": """SELECT CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
        event_id AS seq, user_id AS id, event_type AS status, value, ts
        FROM events""",
    "r_equipment": """SELECT s_suppkey AS equipment_id, s_name AS equipment_name,
        CASE s_suppkey % 4 WHEN 0 THEN '变压器' WHEN 1 THEN '发电机' WHEN 2 THEN '输电线路'
             ELSE '配电设备' END AS equipment_type,
        n_name AS location,
        CASE s_suppkey % 3 WHEN 0 THEN '110kV' WHEN 1 THEN '220kV' ELSE '500kV' END AS voltage_level,
        greatest(s_acctbal, 0) AS capacity_mw,
        DATE '2015-01-01' + CAST(s_suppkey % 3000 AS INTEGER) AS installation_date,
        DATE '2023-01-01' + CAST(s_suppkey % 365 AS INTEGER) AS last_maintenance_date,
        CASE s_suppkey % 5 WHEN 0 THEN 'MAINTENANCE' WHEN 1 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "r_monitoring": """SELECT event_id AS monitoring_id, user_id AS equipment_id,
        215.0::DOUBLE + event_id % 11 AS voltage_a, 215.0::DOUBLE + event_id % 13 AS voltage_b,
        215.0::DOUBLE + event_id % 7 AS voltage_c,
        800.0::DOUBLE + event_id % 50 AS current_a, 800.0::DOUBLE + event_id % 45 AS current_b,
        800.0::DOUBLE + event_id % 40 AS current_c,
        value AS power_active, 10.0::DOUBLE + event_id % 30 AS power_reactive,
        (4990 + event_id % 21) / 100.0::DOUBLE AS frequency,
        20.0::DOUBLE + event_id % 60 AS temperature, 40.0::DOUBLE + event_id % 50 AS humidity,
        ts AS monitoring_time
        FROM events""",
    "r_alarms": """SELECT event_id AS alarm_id, user_id AS equipment_id,
        CASE event_type WHEN 'error' THEN 'FAULT' WHEN 'purchase' THEN 'CRITICAL'
             WHEN 'view' THEN 'INFO' ELSE 'WARNING' END AS alarm_type,
        CAST(1 + event_id % 5 AS INTEGER) AS alarm_level,
        props AS alarm_message, upper(event_type) AS alarm_code,
        event_id % 3 <> 0 AS is_resolved, ts AS occurred_at,
        CASE WHEN event_id % 3 <> 0 THEN ts + to_minutes(CAST(floor(value) AS BIGINT)) END AS resolved_at
        FROM events""",
}

_ROLE_RE = re.compile(r"\b(r_[a-z_]+)\b")


def with_roles(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs of every role (and extra CTE) it references."""
    defs = dict(ROLE_SQL)
    if extra:
        defs.update(extra)
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in defs:
            return
        for dep in _ROLE_RE.findall(defs[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for name in _ROLE_RE.findall(body):
        visit(name)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in order)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":  # merge with the body's own CTE list
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
