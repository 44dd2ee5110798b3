"""Registered change-log queries (Spark job + DuckDB oracle)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import changes as C
from tidemark.operators import quality as Q
from tidemark.plans.catalog import register

TS = "TIMESTAMP '2024-01-30 23:59:59'"
# The state/new split of the upsert walk-through: the log before and after this instant.
CUTOFF = dt.datetime(2024, 1, 15)
CUT = "TIMESTAMP '2024-01-15 00:00:00'"
RANK = "CASE op WHEN 'd' THEN 2 WHEN 'u' THEN 1 WHEN 'c' THEN 0 WHEN 'r' THEN 0 ELSE 1 END"


def _latest_sql(src: str, keep_deletes: bool = False) -> str:
    cond = "" if keep_deletes else " AND op <> 'd'"
    return f"""SELECT id, op, seq, status, value, ts FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, {RANK} DESC) AS rn FROM {src}) x
        WHERE rn = 1{cond}"""


def _cut(c):
    return F.lit(CUTOFF.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


CTES = {
    "r_state": _latest_sql("(SELECT * FROM r_changes WHERE ts < " + CUT + ")"),
}


@register("apply_changes", sql=_latest_sql("r_changes"))
def q_apply_changes(c):
    """Flagship: the current state of the change log (latest per key, deletes removed)."""
    return C.apply_changes(c.changes, ["id"])


@register("upsert_row", sql=_latest_sql(
    f"""(SELECT id, op, seq, status, value, ts FROM r_state UNION ALL
    SELECT id, op, seq, status, value, ts FROM r_changes WHERE ts >= {CUT} AND op <> 'd')"""),
    extra_ctes=CTES)
def q_upsert_row(c):
    """State as of the cutoff, then every later non-delete change upserted by key."""
    ch = c.changes
    state = C.apply_changes(ch.where(F.col("ts") < _cut(c)), ["id"])
    rows = ch.where((F.col("ts") >= _cut(c)) & (F.col("op") != "d"))
    return C.upsert(state, rows, ["id"])


@register("upsert_do_nothing", sql=f"""SELECT * FROM r_state UNION ALL
    SELECT id, op, seq, status, value, ts FROM ({_latest_sql(
        "(SELECT * FROM r_changes WHERE ts >= " + CUT + " AND op = 'c')", keep_deletes=True)}) n
    WHERE id NOT IN (SELECT id FROM r_state)""", extra_ctes=CTES)
def q_upsert_do_nothing(c):
    """INSERT … ON CONFLICT DO NOTHING of the later creates into the state."""
    ch = c.changes
    state = C.apply_changes(ch.where(F.col("ts") < _cut(c)), ["id"])
    creates = C.latest_changes(ch.where((F.col("ts") >= _cut(c)) & (F.col("op") == "c")), ["id"])
    return C.insert_missing(state, creates.select(*state.columns), ["id"])


@register("append_log", sql="SELECT * FROM r_logs")
def q_append_log(c):
    """The log plus a redelivered copy of its last day: the key drops the copies."""
    logs = c.logs
    redelivered = logs.where(F.col("created_at") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
    return C.append_log(logs.unionByName(redelivered), "log_id")


@register("cdc_sync_equipment", sql=f"""
    SELECT e.equipment_id, e.equipment_name, coalesce(a.status, e.status) AS status,
        coalesce(a.at, TIMESTAMP '2015-01-01') AS updated_at, {TS} AS sync_timestamp
    FROM r_equipment e LEFT JOIN (SELECT equipment_id, 'ALARM' AS status, max(occurred_at) AS at
        FROM r_alarms GROUP BY equipment_id) a USING (equipment_id)
    WHERE e.status <> 'INACTIVE'""")
def q_cdc_sync_equipment(c):
    """Change rows of the equipment table: every unit is created, one with alarms is updated (its status, and
    updated_at by the table's trigger rule), an inactive one is deleted; the sync keeps the current rows."""
    cols = ["op", "seq", "equipment_id", "equipment_name", "status", "updated_at"]
    unit = c.equipment.select("equipment_id", "equipment_name", "status",
                              F.lit("2015-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    made = unit.select(F.lit("c").alias("op"), F.lit(1).alias("seq"), *cols[2:])
    last = c.alarms.groupBy("equipment_id").agg(F.max("occurred_at").alias("at"))
    hit = C.touch_updated_at(unit.join(last, "equipment_id").withColumn("status", F.lit("ALARM")), F.col("at"))
    changed = hit.select(F.lit("u").alias("op"), F.lit(2).alias("seq"), *cols[2:])
    gone = unit.where("status = 'INACTIVE'").select(F.lit("d").alias("op"), F.lit(3).alias("seq"), *cols[2:])
    state = C.apply_changes(made.unionByName(changed).unionByName(gone), ["equipment_id"])
    return C.sync_with_timestamp(state.drop("op", "seq"), c.events_as_of)


@register("key_uniqueness", sql="""SELECT order_id, l_linenumber, COUNT(*) AS row_count FROM r_items
    GROUP BY order_id, l_linenumber HAVING COUNT(*) > 1""")
def q_key_uniqueness(c):
    """(order_id, line number) is declared as the item key but is not unique in the data."""
    return Q.key_uniqueness(c.items, ["order_id", "l_linenumber"])


@register("union_distinct", sql="""SELECT location AS region FROM r_devices
    UNION SELECT grid_region FROM r_dispatch""")
def q_union_distinct(c):
    return (c.devices.select(F.col("location").alias("region"))
            .union(c.dispatch.select(F.col("grid_region").alias("region"))).distinct())
