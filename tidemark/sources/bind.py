"""Role bindings: the reference's source tables expressed over the driver tables.

Each function returns the role's canonical columns (see SURVEY §7.2 and
FIXTURES §3). Dimensions of fixed size (``region`` 5 rows, ``nation`` 25 rows)
are broadcast explicitly; every other join is left to the planner (AQE turns a
sort-merge join into a broadcast at run time when the measured side is small).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import Tables

# Fixed values of the bound domains.
# Device types (six, as in the reference's generator), in index order 0..5.
DEVICE_TYPES = ["变压器", "发电机", "输电线路", "配电设备", "开关设备", "继电保护"]
# Equipment types of the equipment master table, index order 0..3.
EQUIPMENT_TYPES = ["变压器", "发电机", "输电线路", "配电设备"]

TS0_USERS = "TIMESTAMP_NTZ '1995-01-01 00:00:00'"


def _pick(index: Column, values: list[str]) -> Column:
    """values[index] for a small fixed list (index is non-negative)."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr


def _plus_minutes(ts: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes.cast("int"), ts)


def _money(x: Column) -> Column:
    """``x`` as decimal(12,2). A number that is the double next to some whole cents is taken from these: the cast goes by way
    of its text, ten times as slow."""
    cents, kind = F.rint(x * 100), "decimal(12,2)"
    exact = (F.abs(x) < F.lit(1e9)) & (cents / F.lit(100.0) == x)
    return F.when(exact, (cents.cast("bigint").cast("decimal(12,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(kind)).otherwise(x.cast(kind))


def users(t: Tables) -> DataFrame:
    c = t.customer
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.concat(F.col("c_name"), F.lit("@"), F.lower(F.col("c_mktsegment"))).alias("email"),
        F.expr(TS0_USERS).alias("created_at"),
        F.expr(TS0_USERS).alias("updated_at"),
    )


def orders(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        _money(F.col("o_totalprice")).alias("order_amount"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "pending")
        .otherwise("cancelled").alias("order_status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def order_items(t: Tables) -> DataFrame:
    """lineitem ⋈ part. Item key = (order_id, l_linenumber, item_partkey, item_suppkey, created_at)."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                           "l_quantity", "l_shipdate")
    # the price is converted once a part, not once a line
    p = t.part.select("p_partkey", "p_name", F.col("p_retailprice").cast("decimal(10,2)").alias("unit_price"))
    j = li.join(p, li.l_partkey == p.p_partkey, "inner")
    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber"),
        F.col("l_partkey").alias("item_partkey"),
        F.col("l_suppkey").alias("item_suppkey"),
        F.col("p_name").alias("product_name"),
        F.col("l_quantity").cast("int").alias("quantity"),
        "unit_price",
        F.col("l_shipdate").alias("created_at"),
    )


def agents(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    n = F.broadcast(t.nation.select("n_nationkey", "n_name"))  # 25 rows, fixed
    return s.join(n, s.s_nationkey == n.n_nationkey, "inner").select(
        F.col("s_suppkey").alias("agent_id"),
        F.col("s_name").alias("agent_name"),
        F.col("n_name").alias("department"),
        F.when(F.col("s_acctbal") >= 0, "online").otherwise("offline").alias("status"),
    )


def tickets(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    et, v = F.col("event_type"), F.col("value")
    return e.select(
        F.col("event_id").alias("ticket_id"),
        F.col("user_id").alias("customer_id"),
        F.when(et == "signup", F.lit(None).cast("bigint")).otherwise(F.col("user_id")).alias("agent_id"),
        F.concat(et, F.lit(" #"), F.col("event_id").cast("string")).alias("title"),
        F.when(v >= 100, "high").when(v >= 20, "medium").otherwise("low").alias("priority"),
        F.when(et == "view", "in_progress").when(et == "purchase", "resolved")
        .when(et == "error", "closed").otherwise("pending").alias("status"),
        et.alias("category"),
        F.col("ts").alias("created_at"),
        _plus_minutes(F.col("ts"), F.floor(v)).alias("updated_at"),
        F.when(et.isin("purchase", "error"), _plus_minutes(F.col("ts"), F.floor(v * 10)))
        .alias("closed_at"),
    )


def ticket_logs(t: Tables) -> DataFrame:
    """Append-only action log: one event per log row, four logs share a ticket."""
    e = t.events.select("event_id", "ts", "user_id", "event_type", "props")
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("log_id"),
        (F.col("event_id") - F.col("event_id") % 4).alias("ticket_id"),
        F.col("user_id").alias("agent_id"),
        et.alias("action"),
        F.lit("pending").alias("old_value"),
        F.when(et == "view", "in_progress").when(et == "purchase", "resolved")
        .when(et == "error", "closed").otherwise("pending").alias("new_value"),
        F.col("props").alias("comment"),
        F.col("ts").alias("created_at"),
    )


def devices(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    n = F.broadcast(t.nation.select("n_nationkey", "n_regionkey"))  # fixed size
    r = F.broadcast(t.region.select("r_regionkey", "r_name"))  # fixed size
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    k = F.col("s_suppkey")
    m4 = k % 4
    return j.select(
        k.alias("device_id"),
        F.col("s_name").alias("device_name"),
        _pick(k % 6, DEVICE_TYPES).alias("device_type"),
        F.col("r_name").alias("location"),
        F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("capacity_mw"),
        F.timestamp_add("DAY", (k % 3000).cast("int"), F.expr(TS0_USERS)).alias("installation_date"),
        (F.lit(0.80) + (k % 19).cast("double") / F.lit(100.0)).alias("efficiency_rate"),
        F.when(m4 == 0, "NORMAL").when(m4 == 1, "WARNING").when(m4 == 2, "MAINTENANCE")
        .otherwise("CRITICAL").alias("maintenance_status"),
        (F.lit(210.0) + k % 40).alias("real_time_voltage"),
        (F.lit(50.0) + k % 150).alias("real_time_current"),
        (F.lit(20.0) + k % 60).alias("real_time_temperature"),
    )


def dispatch(t: Tables) -> DataFrame:
    """Dispatch readings in the ODS shape (after the reference's rename projection)."""
    e = t.events.select("event_id", "ts", "user_id", "value")
    r = F.broadcast(t.region.select("r_regionkey", "r_name"))  # 5 rows, fixed
    j = e.join(r, (F.col("user_id") % 5) == r.r_regionkey)
    k = F.col("event_id")
    m5 = k % 5
    return j.select(
        k.alias("dispatch_id"),
        F.col("ts").alias("event_time"),
        F.col("r_name").alias("grid_region"),
        (F.lit(15000.0) + (k % 97) * 100).alias("total_demand_mw"),
        (F.lit(15000.0) + F.col("value") * 20).alias("total_supply_mw"),
        ((F.lit(497) + k % 7).cast("double") / F.lit(10.0)).alias("frequency_hz"),
        (F.lit(580.0) + k % 200).alias("voltage_level_kv"),
        F.when(k % 3 == 0, "BALANCED").otherwise("STRESSED").alias("load_balance_status"),
        F.when(m5 == 0, "CRITICAL").when(m5 == 1, "HIGH").otherwise("NORMAL").alias("emergency_level"),
    )


def dispatch_feed(t: Tables) -> DataFrame:
    """Dispatch readings under the column names of their change source."""
    return dispatch(t).select(
        "dispatch_id", "grid_region", F.col("event_time").alias("dispatch_time"), F.col("total_demand_mw").alias("load_demand_mw"),
        F.col("total_supply_mw").alias("supply_capacity_mw"), "emergency_level", "load_balance_status",
        F.col("frequency_hz").alias("grid_frequency_hz"), F.col("voltage_level_kv").alias("voltage_stability"))


def change_log(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    et = F.col("event_type")
    return e.select(
        F.when(et == "signup", "c").when(et == "error", "d").otherwise("u").alias("op"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("id"),
        et.alias("status"),
        F.col("value"),
        F.col("ts"),
    )


# --- equipment monitoring domain (power_equipment / power_monitoring / equipment_alarms)

def equipment(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    n = F.broadcast(t.nation.select("n_nationkey", "n_name"))
    k = F.col("s_suppkey")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    return j.select(
        k.alias("equipment_id"),
        F.col("s_name").alias("equipment_name"),
        _pick(k % 4, EQUIPMENT_TYPES).alias("equipment_type"),
        F.col("n_name").alias("location"),
        F.when(k % 3 == 0, "110kV").when(k % 3 == 1, "220kV").otherwise("500kV").alias("voltage_level"),
        F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("capacity_mw"),
        F.date_add(F.lit("2015-01-01").cast("date"), (k % 3000).cast("int")).alias("installation_date"),
        F.date_add(F.lit("2023-01-01").cast("date"), (k % 365).cast("int")).alias("last_maintenance_date"),
        F.when(k % 5 == 0, "MAINTENANCE").when(k % 5 == 1, "INACTIVE").otherwise("ACTIVE").alias("status"),
    )


def monitoring(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", "user_id", "value")
    k = F.col("event_id")
    return e.select(
        k.alias("monitoring_id"),
        F.col("user_id").alias("equipment_id"),
        (F.lit(215.0) + k % 11).alias("voltage_a"),
        (F.lit(215.0) + k % 13).alias("voltage_b"),
        (F.lit(215.0) + k % 7).alias("voltage_c"),
        (F.lit(800.0) + k % 50).alias("current_a"),
        (F.lit(800.0) + k % 45).alias("current_b"),
        (F.lit(800.0) + k % 40).alias("current_c"),
        F.col("value").alias("power_active"),
        (F.lit(10.0) + k % 30).alias("power_reactive"),
        ((F.lit(4990) + k % 21).cast("double") / F.lit(100.0)).alias("frequency"),
        (F.lit(20.0) + k % 60).alias("temperature"),
        (F.lit(40.0) + k % 50).alias("humidity"),
        F.col("ts").alias("monitoring_time"),
    )


def alarms(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    k, et = F.col("event_id"), F.col("event_type")
    resolved = (k % 3) != 0
    return e.select(
        k.alias("alarm_id"),
        F.col("user_id").alias("equipment_id"),
        F.when(et == "error", "FAULT").when(et == "purchase", "CRITICAL")
        .when(et == "view", "INFO").otherwise("WARNING").alias("alarm_type"),
        (F.lit(1) + k % 5).cast("int").alias("alarm_level"),
        F.col("props").alias("alarm_message"),
        F.upper(et).alias("alarm_code"),
        resolved.alias("is_resolved"),
        F.col("ts").alias("occurred_at"),
        F.when(resolved, _plus_minutes(F.col("ts"), F.floor(F.col("value")))).alias("resolved_at"),
    )
