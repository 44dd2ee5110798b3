"""Registered streaming job: the orders chain maintained incrementally from a
change stream (Structured Streaming, foreachBatch), checked against the batch
SQL over the final state — the stream result must equal the batch result."""

from __future__ import annotations

import uuid

from tidemark.operators import orders as O
from tidemark.plans.catalog import SEG_HIGH, SEG_MEDIUM, register
from tidemark.plans import q_equipment, q_grid, q_scenarios
from tidemark.plans.q_orders import DASHBOARD, DASHBOARD_DESC, USER_STATS_LEFT
from tidemark.plans.roles_sql import ROLE_SQL
from tidemark.session import shared_path
from tidemark.sources import changes as CH
from tidemark.streaming import grid_totals as GT
from tidemark.streaming import totals as TT
from tidemark.streaming.equipment_totals import EquipmentDays
from tidemark.streaming.incremental import run_chain_from_tables

FINAL = {"r_final": "SELECT * FROM r_orders WHERE order_status <> 'cancelled'"}
FINAL_TICKETS = {"r_final": "SELECT * FROM r_tickets WHERE ticket_id % 17 <> 0"}
FINAL_ITEMS = {"r_final": "SELECT * FROM r_items WHERE order_id % 13 <> 0"}


@register("incremental_user_stats", sql=USER_STATS_LEFT.format(orders="r_final"), extra_ctes=FINAL)
def q_incremental_user_stats(c):
    """Users and order lifecycle events (create → final status, cancelled
    orders deleted) staged as 3 event-time ranges, streamed one range per
    micro-batch through ODS → DWD → DWS with affected-key recompute."""
    chain = run_chain_from_tables(c.spark, c.t, n_batches=3, files_per_batch=4)
    return chain.user_stats()


@register("incremental_segments", sql=f"""SELECT user_id, username, ['low_value', 'medium_value', 'high_value'][
        1 + (total_amount >= {SEG_MEDIUM})::INT + (total_amount >= {SEG_HIGH})::INT] AS segment_type, total_amount,
    total_orders AS order_count, avg_order_amount, DATE '2001-08-01' - last_order_date::DATE AS last_order_days
    FROM ({USER_STATS_LEFT.format(orders='r_final')}) s""", extra_ctes=FINAL)
def q_incremental_segments(c):
    """Segments of the users as the streamed chain leaves them."""
    stats = run_chain_from_tables(c.spark, c.t, n_batches=2, files_per_batch=4).user_stats()
    return O.user_segments(stats, c.orders_as_of, SEG_HIGH, SEG_MEDIUM).drop("update_time")


def _run(c, make, changes, n_batches: int = 3, files: int = 4):
    """The change log landed as ``n_batches`` event-time ranges and streamed through a chain, one range per micro-batch."""
    root = shared_path(c.spark, make.__name__, uuid.uuid4().hex)
    files = CH.stage_change_files(changes, f"{root}/changes", n_batches, files)
    chain = make(c.spark, root)
    chain.run(CH.read_change_stream(c.spark, f"{root}/changes", changes.schema, files), f"{root}/checkpoint")
    return chain


@register("incremental_agent_workload", sql="""WITH n AS (SELECT agent_id, count(*) FILTER (status IN ('pending', 'in_progress')) AS open,
        count(*) FILTER (status = 'resolved' AND updated_at::DATE = DATE '2024-01-30') AS today,
        avg(date_sub('minute', created_at, updated_at)) AS m FROM r_final GROUP BY agent_id)
    SELECT agent_id, agent_name, department, coalesce(open, 0) AS active_tickets, coalesce(today, 0) AS resolved_today,
    m AS avg_response_time_minutes FROM r_agents LEFT JOIN n USING (agent_id)""", extra_ctes=FINAL_TICKETS)
def q_incremental_agent_workload(c):
    """Tickets created, reassigned, finished and deleted; the workload follows by signed deltas."""
    return _run(c, TT.TicketTotals, CH.ticket_change_log(c.t)).agent_workload(c.agents, c.events_as_of)


@register("incremental_daily_tickets", sql="""SELECT created_at::DATE AS stat_date, count(*) AS total_created,
    count(*) FILTER (status = 'resolved') AS total_resolved, count(*) FILTER (status = 'closed') AS total_closed,
    avg(date_sub('hour', created_at, closed_at)) AS avg_resolution_time_hours FROM r_final GROUP BY ALL""",
          extra_ctes=FINAL_TICKETS)
def q_incremental_daily_tickets(c):
    return _run(c, TT.TicketTotals, CH.ticket_change_log(c.t)).daily_stats()


@register("incremental_ticket_dashboard", sql="""WITH one AS (SELECT count(*)::DOUBLE AS total_tickets,
        (count(*) FILTER (status = 'pending'))::DOUBLE AS pending_tickets,
        avg(date_sub('hour', created_at, closed_at)) AS avg_resolution_time FROM r_final)
    SELECT metric_name, metric_value FROM (UNPIVOT one ON total_tickets, pending_tickets, avg_resolution_time
        INTO NAME metric_name VALUE metric_value)""", extra_ctes=FINAL_TICKETS)
def q_incremental_ticket_dashboard(c):
    return _run(c, TT.TicketTotals, CH.ticket_change_log(c.t), 2).dashboard()


@register("incremental_daily_stats", sql="""SELECT created_at::DATE AS stat_date, count(*) AS total_orders,
    sum(order_amount)::DOUBLE AS total_amount, count(*) FILTER (order_status = 'completed') AS completed_orders,
    count(*) FILTER (order_status = 'pending') AS pending_orders FROM r_final GROUP BY ALL""", extra_ctes=FINAL)
def q_incremental_daily_stats(c):
    return _run(c, TT.OrderTotals, CH.chain_versions(c.t)).daily_stats()


@register("incremental_sales_trend", sql="""SELECT date_trunc('hour', created_at) AS hour_start, sum(order_amount)::DOUBLE AS total_sales,
    count(*) AS order_count, sum(order_amount)::DOUBLE / count(*) AS avg_order_value FROM r_final
    WHERE order_status = 'completed' GROUP BY ALL""", extra_ctes=FINAL)
def q_incremental_sales_trend(c):
    return _run(c, TT.OrderTotals, CH.chain_versions(c.t), 2).sales_trend()


@register("incremental_dashboard", sql=f"""WITH one AS (SELECT (SELECT count(*) FROM r_users)::DOUBLE AS total_users,
        count(*)::DOUBLE AS total_orders, coalesce(sum(sale), 0)::DOUBLE AS total_sales,
        coalesce(sum(sale)::DOUBLE / count(sale), 0) AS avg_order_value,
        (count(*) FILTER (today))::DOUBLE AS today_orders, coalesce(sum(sale) FILTER (today), 0)::DOUBLE AS today_sales
        FROM (SELECT if(order_status = 'completed', order_amount, NULL) AS sale,
            created_at::DATE = DATE '2001-08-01' AS today FROM r_final))
    SELECT metric_name, metric_value, {DASHBOARD_DESC}[list_position({DASHBOARD}, metric_name)] AS metric_desc
    FROM (UNPIVOT one ON {', '.join(DASHBOARD)} INTO NAME metric_name VALUE metric_value)""", extra_ctes=FINAL)
def q_incremental_dashboard(c):
    return _run(c, TT.OrderTotals, CH.chain_versions(c.t)).dashboard(c.orders_as_of)


@register("incremental_product_stats", sql="""SELECT product_name, sum(quantity)::BIGINT AS total_quantity,
    sum((quantity * unit_price)::DECIMAL(18,2))::DOUBLE AS total_sales, count(DISTINCT order_id) AS total_orders,
    sum(unit_price)::DOUBLE / count(*) AS avg_price FROM r_final GROUP BY product_name""", extra_ctes=FINAL_ITEMS)
def q_incremental_product_stats(c):
    """Items created, corrected and deleted; also the distinct orders of a product follow by deltas."""
    return _run(c, TT.ProductTotals, CH.item_versions(c.t)).product_stats()


def _final(role: str, where: str) -> dict[str, str]:
    """The role as the change stream leaves it."""
    return {role: f"SELECT * FROM ({ROLE_SQL[role]}) WHERE {where}"}


FINAL_GRID = q_grid.CTES | _final("r_dispatch", "dispatch_id % 19 <> 0") | _final("r_devices", "device_id % 23 <> 0")
FINAL_ALARMS = q_scenarios.CTES | _final("r_alarms", "alarm_id % 29 <> 0") | _final("r_monitoring", "monitoring_id % 31 <> 0")


# Exact sums meet halves (73.8647125) that a sum of doubles misses by its rounding: both sides round at 10 places first.
FINAL_GRID["r_summary"] = FINAL_GRID["r_summary"].replace("round(geff, 6)", "round(round(geff, 10), 6)").replace(
    "round(bal, 6)", "round(round(bal, 10), 6)").replace("round(health, 6)", "round(round(health, 10), 6)")


@register("incremental_grid_summary", sql="SELECT * FROM r_summary", extra_ctes=FINAL_GRID)
def q_incremental_grid_summary(c):
    """Dispatches and devices created, corrected and deleted; the pairs of a region-hour follow by bilinear deltas."""
    return _run(c, GT.GridTotals, CH.grid_change_log(c.t)).summary()


@register("incremental_alarm_report", sql=q_scenarios.ALARM_REPORT, extra_ctes=FINAL_ALARMS)
def q_incremental_alarm_report(c):
    """Alarms and late, corrected and withdrawn readings; either side finds the other without a watermark."""
    return _run(c, GT.AlarmTotals, CH.alarm_change_log(c.t)).report(c.equipment, c.events_as_of)


@register("incremental_equipment_daily", sql=q_equipment.DAILY_SUMMARY,
          extra_ctes=q_equipment.CTES | _final("r_monitoring", "monitoring_id % 31 <> 0"))
def q_incremental_equipment_daily(c):
    """Readings late, corrected and withdrawn: sums, squares and counts per value of every equipment and day."""
    return _run(c, EquipmentDays, CH.alarm_change_log(c.t)).summary(c.equipment)
