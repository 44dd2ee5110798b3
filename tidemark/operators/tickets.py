"""Support-ticket domain: live metrics, agent workload/performance, rankings and
the ad-hoc queries run against the live ticket table.

Agent-level results pre-aggregate tickets by ``agent_id`` (map-side partial
aggregation absorbs a hot agent) and then join the one-row-per-agent result to
the agent dimension, so the join never sees more than one row per agent.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.operators.metrics import metric_rows
from tidemark.operators.ranking import global_rank


ts_lit = R.ts_lit


def day_bounds(day: dt.date, days: int = 1) -> tuple[F.Column, F.Column]:
    lo = F.lit(day.strftime("%Y-%m-%d 00:00:00")).cast("timestamp_ntz")
    return lo, F.timestamp_add("DAY", F.lit(days), lo)


def on_day(ts: F.Column, day: dt.date) -> F.Column:
    """DATE(ts) = day, written as a range so Parquet row groups can be skipped."""
    lo, hi = day_bounds(day)
    return (ts >= lo) & (ts < hi)


def since_day(ts: F.Column, day: dt.date) -> F.Column:
    """DATE(ts) >= day as a range predicate."""
    return ts >= F.lit(day.strftime("%Y-%m-%d 00:00:00")).cast("timestamp_ntz")


def _st(v: str) -> F.Column:
    return F.col("status") == v


def micros(c: str) -> F.Column:
    return F.unix_micros(F.to_timestamp(F.col(c)))


def avg_epoch_hours(start: str, end: str) -> F.Column:
    """AVG(EXTRACT(EPOCH FROM end - start) / 3600) from an exact integer sum."""
    d = micros(end) - micros(start)
    return F.sum(d).cast("double") / F.count(d) / F.lit(3_600_000_000.0)


# ------------------------------------------------------------------- DWD

def ticket_metrics(tickets: DataFrame, as_of: dt.datetime) -> DataFrame:
    closed = F.col("closed_at").isNotNull() & F.col("created_at").isNotNull()
    return tickets.agg(
        F.count(F.lit(1)).alias("total_tickets"),
        R.sum_if(_st("pending")).alias("pending_tickets"),
        R.sum_if(_st("in_progress")).alias("in_progress_tickets"),
        R.sum_if(_st("resolved")).alias("resolved_tickets"),
        R.sum_if(_st("closed")).alias("closed_tickets"),
        F.avg(F.when(closed, R.minutes_between("created_at", "closed_at")))
        .alias("avg_resolution_time_minutes"),
    ).select(ts_lit(as_of).alias("metric_time"), "*")


def _per_agent(tickets: DataFrame, today: dt.date) -> DataFrame:
    both = F.col("updated_at").isNotNull() & F.col("created_at").isNotNull()
    return tickets.where(F.col("agent_id").isNotNull()).groupBy(
        F.col("agent_id").alias("t_agent_id")).agg(
        F.count("ticket_id").alias("n_tickets"),
        R.count_if(F.col("status").isin("pending", "in_progress")).alias("active_tickets"),
        R.count_if(_st("resolved")).alias("resolved_tickets"),
        R.count_if(_st("resolved") & on_day(F.col("updated_at"), today)).alias("resolved_today"),
        F.sum(F.when(both, R.minutes_between("created_at", "updated_at"))).alias("_resp_sum"),
        F.count(F.when(both, F.lit(1))).alias("_resp_n"),
        F.sum(F.when(F.col("closed_at").isNotNull() & F.col("created_at").isNotNull(),
                     R.hours_between("created_at", "closed_at"))).alias("_res_h_sum"),
        F.count(F.when(F.col("closed_at").isNotNull() & F.col("created_at").isNotNull(),
                       F.lit(1))).alias("_res_h_n"),
    )


def _agents_left(agents: DataFrame, tickets: DataFrame, today: dt.date) -> DataFrame:
    """agents LEFT JOIN (tickets pre-aggregated per agent)."""
    per = _per_agent(tickets, today)
    j = agents.join(per, agents.agent_id == per.t_agent_id, "left")
    z = F.lit(0).cast("bigint")
    return j.select(
        "agent_id", "agent_name", "department", "status",
        F.coalesce("n_tickets", z).alias("n_tickets"),
        F.coalesce("active_tickets", z).alias("active_tickets"),
        F.coalesce("resolved_tickets", z).alias("resolved_tickets"),
        F.coalesce("resolved_today", z).alias("resolved_today"),
        (F.col("_resp_sum").cast("double") / F.col("_resp_n")).alias("avg_response_time_minutes"),
        (F.col("_res_h_sum").cast("double") / F.col("_res_h_n")).alias("avg_resolution_hours"),
    )


def agent_workload(agents: DataFrame, tickets: DataFrame, as_of: dt.datetime) -> DataFrame:
    j = _agents_left(agents, tickets, as_of.date())
    return j.select("agent_id", "agent_name", "department", "active_tickets", "resolved_today",
                    "avg_response_time_minutes", ts_lit(as_of).alias("last_updated"))


# ------------------------------------------------------------------- DWS

def daily_ticket_stats(tickets: DataFrame) -> DataFrame:
    closed = F.col("closed_at").isNotNull() & F.col("created_at").isNotNull()
    return tickets.groupBy(F.to_date("created_at").alias("stat_date")).agg(
        F.count(F.lit(1)).alias("total_created"),
        R.sum_if(_st("resolved")).alias("total_resolved"),
        R.sum_if(_st("closed")).alias("total_closed"),
        F.avg(F.when(closed, R.hours_between("created_at", "closed_at")))
        .alias("avg_resolution_time_hours"),
    )


def agent_performance(agents: DataFrame, tickets: DataFrame) -> DataFrame:
    """agents INNER JOIN tickets per (agent, created date); rate in 0–1."""
    closed = F.col("closed_at").isNotNull() & F.col("created_at").isNotNull()
    per = tickets.where(F.col("agent_id").isNotNull()).groupBy(
        F.col("agent_id").alias("t_agent_id"), F.to_date("created_at").alias("stat_date")).agg(
        F.count("ticket_id").alias("tickets_handled"),
        R.sum_if(_st("resolved")).alias("tickets_resolved"),
        F.avg(F.when(closed, R.hours_between("created_at", "closed_at")))
        .alias("avg_resolution_time_hours"))
    a = agents.select("agent_id", "agent_name")
    j = a.join(per, a.agent_id == per.t_agent_id, "inner")
    return j.select(
        "agent_id", "agent_name", "stat_date", "tickets_handled", "tickets_resolved",
        (F.col("tickets_resolved").cast("double") / F.col("tickets_handled")).alias("resolution_rate"),
        "avg_resolution_time_hours")


# ------------------------------------------------------------------- ADS

def ticket_dashboard(tickets: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Three metric rows keyed 1..3 from one scan."""
    one = tickets.agg(
        F.count(F.lit(1)).cast("double").alias("total_tickets"),
        R.count_if(_st("pending")).cast("double").alias("pending_tickets"),
        F.avg(F.when(F.col("closed_at").isNotNull(), R.hours_between("created_at", "closed_at")))
        .alias("avg_resolution_time"))
    rows = metric_rows(one, ["total_tickets", "pending_tickets", "avg_resolution_time"])
    ids = F.create_map(F.lit("total_tickets"), F.lit(1), F.lit("pending_tickets"), F.lit(2),
                       F.lit("avg_resolution_time"), F.lit(3))
    # Fixed metric descriptions of the ticket dashboard.
    desc = F.create_map(F.lit("total_tickets"), F.lit("总工单数"),
                        F.lit("pending_tickets"), F.lit("待处理工单数"),
                        F.lit("avg_resolution_time"), F.lit("平均解决时间(小时)"))
    m = F.col("metric_name")
    return rows.select(ids[m].alias("dashboard_id"), m, "metric_value",
                       desc[m].alias("metric_desc"), ts_lit(as_of).alias("update_time"))


def agent_ranking(agents: DataFrame, tickets: DataFrame, as_of: dt.datetime) -> DataFrame:
    """ROW_NUMBER over resolved count (desc), agent_id as deterministic tiebreak."""
    j = _agents_left(agents, tickets, as_of.date()).select(
        "agent_id", "agent_name", "department",
        F.lit("resolution_count").alias("rank_type"),
        F.col("resolved_tickets").cast("double").alias("rank_value"))
    r = global_rank(j, [F.col("rank_value").desc(), F.col("agent_id").asc()], "ranking")
    return r.select("agent_id", "agent_name", "department", "rank_type", "rank_value",
                    "ranking",
                    ts_lit(as_of).alias("update_time"))


def status_distribution(tickets: DataFrame) -> DataFrame:
    """count and share of total per status; the total is summed over the grouped
    rows (one per status), so the tickets are read once."""
    total = F.sum("ticket_count").over(Window.partitionBy())
    g = tickets.groupBy("status").agg(F.count(F.lit(1)).alias("ticket_count"))
    return g.withColumn("percentage", F.col("ticket_count") * 100.0 / total).orderBy(
        F.col("ticket_count").desc())


def tickets_by_priority(tickets: DataFrame, priority: str = "high") -> DataFrame:
    return (tickets.where(F.col("priority") == priority)
            .select("ticket_id", "title", "priority", "status", "agent_id", "created_at", "updated_at")
            .orderBy(F.col("created_at").desc()))


def open_tickets(tickets: DataFrame) -> DataFrame:
    """Projection-pruned read of open tickets; priority sorts as text (desc)."""
    return (tickets.where(F.col("status").isin("pending", "in_progress"))
            .select("ticket_id", "title", "status", "priority")
            .orderBy(F.col("priority").desc(), F.col("created_at").desc()))


def pending_tickets(tickets: DataFrame) -> DataFrame:
    return tickets.where(_st("pending")).select(
        "ticket_id", "agent_id", "title", "priority", "status", "created_at", "updated_at").orderBy("ticket_id")


def hourly_ticket_trend(tickets: DataFrame, as_of: dt.datetime) -> DataFrame:
    today = tickets.where(on_day(F.col("created_at"), as_of.date()))
    return today.groupBy(F.date_format("created_at", "yyyy-MM-dd HH:00:00").alias("hour_window")).agg(
        F.count(F.lit(1)).alias("tickets_created"),
        R.count_if(F.col("priority") == "high").alias("high_priority_tickets"),
        R.count_if(_st("resolved")).alias("resolved_tickets"),
    ).orderBy("hour_window")


def latest_logs(logs: DataFrame, n: int = 10) -> DataFrame:
    """Newest n log rows (top-k: per-partition top n, then one merge of n×partitions)."""
    return logs.select("log_id", "ticket_id", "action", "old_value", "new_value", "comment",
                       "created_at").orderBy(F.col("created_at").desc(), F.col("log_id").desc()).limit(n)


def priority_resolution(tickets: DataFrame) -> DataFrame:
    order = F.when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2) \
        .when(F.col("priority") == "low", 3)
    return tickets.groupBy("priority").agg(
        F.count(F.lit(1)).alias("ticket_count"),
        avg_epoch_hours("created_at", "closed_at").alias("avg_resolution_hours"),
    ).orderBy(order)


def daily_ticket_breakdown(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy(F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("total_created"),
        R.count_if(_st("resolved")).alias("resolved"),
        R.count_if(_st("pending")).alias("pending"),
        R.count_if(_st("in_progress")).alias("in_progress"),
        avg_epoch_hours("created_at", "closed_at").alias("avg_resolution_hours"),
    ).orderBy(F.col("date").desc())


def agent_resolution_rate(agents: DataFrame, tickets: DataFrame, as_of: dt.datetime) -> DataFrame:
    """ROUND(100·resolved / NULLIF(total, 0), 2) per agent, HAVING total > 0."""
    j = _agents_left(agents, tickets, as_of.date()).where(F.col("n_tickets") > 0)
    return j.select(
        "agent_name", "department", F.col("n_tickets").alias("total_handled"),
        F.col("resolved_tickets").alias("resolved_count"),
        F.round(F.col("resolved_tickets") * 100.0 / F.nullif(F.col("n_tickets"), F.lit(0)), 2)
        .alias("resolution_rate"),
        F.col("avg_resolution_hours"),
    ).orderBy(F.col("resolution_rate").desc(), F.col("resolved_count").desc())


def adhoc_workload(agents: DataFrame, tickets: DataFrame, as_of: dt.datetime) -> DataFrame:
    j = _agents_left(agents, tickets, as_of.date())
    return j.select("agent_name", "department", F.col("status").alias("agent_status"),
                    F.col("n_tickets").alias("total_tickets"), "resolved_tickets",
                    "active_tickets").orderBy(F.col("resolved_tickets").desc())


def workload_with_rate(agents: DataFrame, tickets: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Workload of every agent with the resolution rate in %; NULL, not 0, for an agent without tickets."""
    total, done = F.col("n_tickets"), F.col("resolved_tickets")
    return _agents_left(agents, tickets, as_of.date()).select(
        "agent_name", "department", F.col("status").alias("agent_status"), total.alias("total_tickets"), "resolved_tickets",
        "active_tickets", F.round(F.try_divide(done * 100.0, total), 2).alias("resolution_rate")).orderBy(done.desc())


def active_tickets_per_agent(tickets: DataFrame) -> DataFrame:
    return tickets.where(_st("in_progress")).groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("active_tickets"))


def daily_tickets_since(tickets: DataFrame, since: dt.date) -> DataFrame:
    return tickets.where(since_day(F.col("created_at"), since)).groupBy(
        F.to_date("created_at").alias("date")).agg(F.count(F.lit(1)).alias("daily_tickets"))


def resolution_time_7d(tickets: DataFrame, as_of: dt.datetime) -> DataFrame:
    since = as_of.date() - dt.timedelta(days=7)
    t = tickets.where(_st("resolved") & since_day(F.col("created_at"), since))
    return t.groupBy("agent_id").agg(
        F.avg(R.hours_between("created_at", "updated_at")).alias("avg_resolution_time")
    ).orderBy("avg_resolution_time")
