"""Orders domain: ODS → DWD wide tables → DWS summaries → ADS reports.

Each function takes role DataFrames (``users``, ``orders``, ``items``) and an
``as_of`` date/time instead of the wall clock, so a re-run is idempotent and
the same function serves a full snapshot or one micro-batch's affected keys.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.operators.ranking import global_rank
from tidemark.operators.metrics import metric_rows


_ts = R.ts_lit


def _date(as_of: dt.datetime | dt.date) -> F.Column:
    d = as_of.date() if isinstance(as_of, dt.datetime) else as_of
    return F.lit(d.isoformat()).cast("date")


# ------------------------------------------------------------------- DWD

def dwd_users(users: DataFrame, as_of) -> DataFrame:
    return users.select(
        F.col("id").alias("user_id"), "username", "email", "created_at", "updated_at",
        _ts(as_of).alias("etl_time"))


def dwd_orders(orders: DataFrame, users: DataFrame, as_of, *keep: str) -> DataFrame:
    """orders LEFT JOIN users on user_id (shuffle join on the user key; AQE may
    broadcast users at run time when it is measured small). ``keep``: more columns
    of the orders to carry along."""
    u = users.select(F.col("id").alias("u_id"), "username", "email")
    o = orders.alias("o")
    return o.join(u, o.user_id == u.u_id, "left").select(
        F.col("o.id").alias("order_id"), F.col("o.user_id"), "username", "email",
        F.col("o.order_amount"), F.col("o.order_status"), F.col("o.created_at"),
        F.col("o.updated_at"), _ts(as_of).alias("etl_time"), *[F.col(f"o.{c}") for c in keep])


def dwd_order_items(items: DataFrame, orders: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """items LEFT JOIN orders LEFT JOIN users; total = quantity × unit_price (widened to 18,2)."""
    o = orders.select(F.col("id").alias("o_id"), F.col("user_id"))
    u = users.select(F.col("id").alias("u_id"), "username")
    j = items.join(o, items.order_id == o.o_id, "left").join(u, F.col("user_id") == u.u_id, "left")
    return j.select(
        "order_id", "l_linenumber", "item_partkey", "item_suppkey", "user_id", "username",
        "product_name", "quantity", "unit_price",
        (F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)").alias("total_price"),
        "created_at", _ts(as_of).alias("etl_time"))


def order_facts(orders: DataFrame) -> DataFrame:
    """The DWD order rows for consumers that read no user column.

    ``orders LEFT JOIN users ON user_id = users.id`` keeps exactly one row per
    order because ``id`` is the users' primary key, so a consumer that reads no
    user column gets the same rows without the join (join elimination on a
    declared key — Catalyst cannot do it, it does not know the key is unique)."""
    return orders.select(F.col("id").alias("order_id"), "user_id", "order_amount", "order_status",
                         "created_at", "updated_at")


def item_facts(items: DataFrame) -> DataFrame:
    """DWD item rows without the order/user columns (same key argument as
    ``order_facts``: orders.id and users.id are primary keys)."""
    return items.select(
        "order_id", "l_linenumber", "item_partkey", "item_suppkey", "product_name", "quantity", "unit_price",
        (F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)").alias("total_price"), "created_at")


def dwd_user_orders(dusers: DataFrame, dorders: DataFrame, as_of) -> DataFrame:
    u = dusers.select("user_id", "username", "email")
    o = dorders.select(F.col("user_id").alias("o_user_id"), "order_id", "order_amount",
                       "order_status", F.col("created_at").alias("order_time"))
    return u.join(o, u.user_id == o.o_user_id, "inner").select(
        "user_id", "username", "email", "order_id", "order_amount", "order_status",
        "order_time", _ts(as_of).alias("etl_time"))


def dwd_order_details(dorders: DataFrame, ditems: DataFrame, as_of) -> DataFrame:
    """Orders with their items. ``ditems`` may be the item facts: no order or user column of the items is read."""
    o = dorders.select(F.col("order_id").alias("o_order_id"), F.col("user_id"), "username",
                       "order_amount", "order_status", F.col("created_at").alias("order_time"))
    i = ditems.select("order_id", "l_linenumber", "item_partkey", "item_suppkey",
                      "product_name", "quantity", "unit_price", "total_price")
    return o.join(i, o.o_order_id == i.order_id, "inner").select(
        "order_id", "user_id", "username", "order_amount", "order_status", "l_linenumber",
        "item_partkey", "item_suppkey", "product_name", "quantity", "unit_price", "total_price",
        "order_time", _ts(as_of).alias("etl_time"))


# ------------------------------------------------------------------- DWS

def user_stats(dorders: DataFrame, dusers: DataFrame, as_of) -> DataFrame:
    """Per user over all orders: count, sum, mean amount, latest order time. Orders
    are aggregated before the users' names are joined, one row per user."""
    per_user = dorders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("order_amount").cast("double").alias("total_amount"),
        R.avg_exact("order_amount").alias("avg_order_amount"),
        F.max("created_at").alias("last_order_date"))
    names = dusers.select(F.col("user_id").alias("u_id"), "username")
    return per_user.join(names, F.col("user_id") == F.col("u_id"), "left").select(
        "user_id", "username", "total_orders", "total_amount", "avg_order_amount", "last_order_date",
        _ts(as_of).alias("etl_time"))


def user_stats_left(dusers: DataFrame, dorders: DataFrame, as_of) -> DataFrame:
    """users LEFT JOIN orders, then WHERE status = 'completed' OR status IS NULL.

    Reproduces the reference: users whose orders are all non-completed vanish;
    users without orders stay with zeros. Orders are pre-aggregated per user
    before the join, so the join carries one row per (user, kept-or-not) and a
    user with millions of orders never becomes a hot join key.
    """
    o = dorders.select("user_id", "order_id", "order_amount", "order_status", "created_at")
    kept = (F.col("order_status") == "completed") | F.col("order_status").isNull()
    per_user = o.groupBy(F.col("user_id").alias("o_user_id")).agg(
        F.count(F.when(kept, F.col("order_id"))).alias("n_kept"),
        F.sum(F.when(kept, F.col("order_amount"))).alias("s_kept"),
        F.count(F.when(kept, F.col("order_amount"))).alias("c_kept"),
        F.max(F.when(kept, F.col("created_at"))).alias("m_kept"),
        F.count(F.lit(1)).alias("n_all"),
        F.max(F.when(kept, F.lit(1)).otherwise(F.lit(0))).alias("any_kept"),
    )
    u = dusers.select("user_id", "username")
    j = u.join(per_user, u.user_id == per_user.o_user_id, "left")
    # keep: no orders at all (NULL-extended row) or at least one kept order
    j = j.where(F.col("n_all").isNull() | (F.col("any_kept") == 1))
    return j.select(
        "user_id", "username",
        F.coalesce(F.col("s_kept").cast("double"), F.lit(0.0)).alias("total_amount"),
        F.coalesce(F.col("n_kept"), F.lit(0)).alias("total_orders"),
        F.coalesce(F.col("s_kept").cast("double") / F.col("c_kept"), F.lit(0.0)).alias("avg_order_amount"),
        F.col("m_kept").alias("last_order_date"),
        _ts(as_of).alias("update_time"),
    )


def product_stats(ditems: DataFrame, as_of) -> DataFrame:
    """Per product: quantity, sales, distinct orders, mean unit price.

    COUNT(DISTINCT order_id) is planned by Catalyst as a two-level aggregate
    (product, order) then product, both with map-side partial aggregation."""
    return ditems.groupBy("product_name").agg(
        F.sum("quantity").alias("total_quantity"),
        F.sum("total_price").cast("double").alias("total_sales"),
        F.countDistinct("order_id").alias("total_orders"),
        R.avg_exact("unit_price").alias("avg_price"),
    ).withColumn("etl_time", _ts(as_of))


def daily_order_stats(dorders: DataFrame, as_of) -> DataFrame:
    st = F.col("order_status")
    return dorders.groupBy(F.to_date("created_at").alias("stat_date")).agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("order_amount").cast("double").alias("total_amount"),
        R.count_if(st == "completed").alias("completed_orders"),
        R.count_if(st == "pending").alias("pending_orders"),
    ).withColumn("etl_time", _ts(as_of))


def realtime_stats(dusers: DataFrame, dorders: DataFrame, as_of) -> DataFrame:
    """Four metric rows. One scan per input table (not four), then unpivot."""
    users = dusers.agg(F.countDistinct("user_id").cast("double").alias("total_users"))
    done = F.col("order_status") == "completed"
    amt = F.when(done, F.col("order_amount"))
    o = dorders.agg(
        F.count(F.lit(1)).cast("double").alias("total_orders"),
        F.sum(amt).cast("double").alias("total_sales"),
        (F.sum(amt).cast("double") / F.count(amt)).alias("avg_order_value"),
    )
    rows = metric_rows(users, ["total_users"]).unionByName(
        metric_rows(o, ["total_orders", "total_sales", "avg_order_value"]))
    return rows.withColumn("update_time", _ts(as_of))


# Fixed metric descriptions of the operations dashboard.
DASHBOARD_DESC = {
    "total_users": "总用户数",
    "total_orders": "总订单数",
    "total_sales": "总销售额",
    "avg_order_value": "平均订单金额",
    "today_orders": "今日订单数",
    "today_sales": "今日销售额",
}


def realtime_dashboard(dusers: DataFrame, dorders: DataFrame, as_of) -> DataFrame:
    """Six metric rows (NULL → 0). Today's predicate is a range on created_at so
    it reaches the Parquet scan as a pushed filter."""
    day0 = _ts(as_of if not isinstance(as_of, dt.datetime) else as_of.date())
    day1 = F.timestamp_add("DAY", F.lit(1), day0)
    today = (F.col("created_at") >= day0) & (F.col("created_at") < day1)
    done = F.col("order_status") == "completed"
    amt = F.when(done, F.col("order_amount"))
    o = dorders.agg(
        F.count(F.lit(1)).cast("double").alias("total_orders"),
        F.coalesce(F.sum(amt).cast("double"), F.lit(0.0)).alias("total_sales"),
        F.coalesce(F.sum(amt).cast("double") / F.count(amt), F.lit(0.0)).alias("avg_order_value"),
        R.count_if(today).cast("double").alias("today_orders"),
        F.coalesce(F.sum(F.when(today & done, F.col("order_amount"))).cast("double"),
                   F.lit(0.0)).alias("today_sales"),
    )
    users = dusers.agg(F.countDistinct("user_id").cast("double").alias("total_users"))
    rows = metric_rows(users, ["total_users"]).unionByName(
        metric_rows(o, ["total_orders", "total_sales", "avg_order_value", "today_orders",
                        "today_sales"]))
    desc = F.create_map(*[x for k, v in DASHBOARD_DESC.items() for x in (F.lit(k), F.lit(v))])
    return rows.select("metric_name", "metric_value", desc[F.col("metric_name")].alias("metric_desc"),
                       _ts(as_of).alias("update_time"))


def user_segments(ustats: DataFrame, as_of, high: float = 500, medium: float = 100) -> DataFrame:
    return ustats.select(
        "user_id", "username",
        R.segment_type(F.col("total_amount"), high, medium).alias("segment_type"),
        "total_amount", F.col("total_orders").alias("order_count"), "avg_order_amount",
        F.datediff(_date(as_of), F.to_date("last_order_date")).alias("last_order_days"),
        _ts(as_of).alias("update_time"))


def sales_trend(dorders: DataFrame, as_of) -> DataFrame:
    """Completed sales per (date, hour); label 'yyyy-MM-dd H:00' (hour not padded)."""
    done = dorders.where(F.col("order_status") == "completed")
    g = done.groupBy(F.to_date("created_at").alias("d"), F.hour("created_at").alias("h")).agg(
        F.sum("order_amount").cast("double").alias("total_sales"),
        F.count(F.lit(1)).alias("order_count"),
        R.avg_exact("order_amount").alias("avg_order_value"))
    return g.select(
        F.concat(F.col("d").cast("string"), F.lit(" "), F.col("h").cast("string"), F.lit(":00"))
        .alias("time_window"),
        F.timestamp_add("HOUR", F.col("h"), F.col("d").cast("timestamp_ntz")).alias("hour_start"),
        "total_sales", "order_count", "avg_order_value", _ts(as_of).alias("update_time"))


def high_value_alerts(segments: DataFrame, as_of) -> DataFrame:
    s = segments.where((F.col("segment_type") == "high_value") & (F.col("last_order_days") > 7))
    return s.select("user_id", "username", "total_amount", "last_order_days",
                    R.churn_alert(F.col("last_order_days")).alias("alert_type"),
                    _ts(as_of).alias("alert_time"))


def business_monitor(dusers: DataFrame, dorders: DataFrame, as_of) -> DataFrame:
    """Order completion rate % and user activity rate % (users with an order
    updated on ``as_of`` over all users; SURVEY §2.13 #5)."""
    done = F.col("order_status") == "completed"
    comp = dorders.agg((R.count_if(done) * 100.0 / F.count(F.lit(1))).cast("double")
                       .alias("order_completion_rate"))
    day0 = _ts(as_of if not isinstance(as_of, dt.datetime) else as_of.date())
    day1 = F.timestamp_add("DAY", F.lit(1), day0)
    active = (dorders.where((F.col("updated_at") >= day0) & (F.col("updated_at") < day1))
              .select("user_id"))
    u = dusers.select("user_id")
    # users that have an order updated today: semi join, no row multiplication
    active_users = u.join(active, "user_id", "left_semi")
    # numerator and denominator as two one-row aggregates, combined by a global agg
    num = active_users.agg(F.countDistinct("user_id").alias("n"), F.lit(None).cast("bigint").alias("d"))
    den = u.agg(F.lit(None).cast("bigint").alias("n"), F.countDistinct("user_id").alias("d"))
    act = num.unionByName(den).agg(
        (F.max("n") * 100.0 / F.max("d")).cast("double").alias("user_activity_rate"))
    rows = metric_rows(comp, ["order_completion_rate"]).unionByName(
        metric_rows(act, ["user_activity_rate"]))
    # Fixed metric descriptions of the business monitor.
    desc = F.create_map(F.lit("order_completion_rate"), F.lit("订单完成率(%)"),
                        F.lit("user_activity_rate"), F.lit("用户活跃率(%)"))
    return rows.select("metric_name", "metric_value", desc[F.col("metric_name")].alias("metric_desc"),
                       _ts(as_of).alias("update_time"))


def product_ranking(pstats: DataFrame, as_of) -> DataFrame:
    """RANK() OVER (ORDER BY total_sales DESC), computed in parallel (no
    single-partition window)."""
    base = pstats.select("product_name", "total_sales", "total_quantity", "total_orders")
    # product_name spreads equal sales values over sort partitions; ties still share a rank
    ranked = global_rank(base, [F.col("total_sales").desc(), F.col("product_name").asc()], "sales_rank",
                         method="rank", tie_cols=["total_sales"])
    return ranked.withColumn("update_time", _ts(as_of))
