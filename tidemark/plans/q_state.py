"""Registered queries on the state layer: the keyed table after several batches, as of
an earlier one, across a restart with two writers, by key, and the hot/cold cycle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.plans.catalog import register
from tidemark.plans.q_changes import CUT, CUTOFF, _latest_sql
from tidemark.session import shared_path
from tidemark.streaming.jobs import tier_cycle
from tidemark.streaming.pktable import PKTable

COLS = ["id", "op", "seq", "status", "value", "ts"]
IDS = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]
IN = ", ".join(map(str, IDS))
ARCHIVED = "created_at < TIMESTAMP '2024-01-23 00:00:00'"


def _path(c, name: str) -> str:
    return shared_path(c.spark, name, uuid.uuid4().hex)


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _since(cut):
    """Rows from ``cut`` on; those without a time go with the later ones."""
    return (F.col("ts") >= cut) | F.col("ts").isNull()


@register("pk_table_latest", sql=_latest_sql("r_changes"))
def q_pk_table_latest(c):
    """The change log in three batches, compacted after the second."""
    t = PKTable(c.spark, _path(c, "pk_latest"), ["id"], buckets=8)
    one, two = _at("2024-01-10"), _at("2024-01-20")
    for b, part in enumerate([F.col("ts") < one, (F.col("ts") >= one) & (F.col("ts") < two), _since(two)]):
        t.write_batch(c.changes.where(part), b)
        if b == 1:
            t.compact()
    return t.read().select(*COLS)


@register("pk_table_as_of", sql=_latest_sql(f"(SELECT * FROM r_changes WHERE ts < {CUT})"))
def q_pk_table_as_of(c):
    """The state before the second of two batches."""
    t = PKTable(c.spark, _path(c, "pk_as_of"), ["id"], buckets=8)
    cut = _at(str(CUTOFF))
    t.write_batch(c.changes.where(F.col("ts") < cut), 0)
    t.write_batch(c.changes.where(_since(cut)), 1)
    return t.as_of(0).select(*COLS)


@register("pk_table_restart", sql=_latest_sql("r_changes"))
def q_pk_table_restart(c):
    """A new process goes on with a batch of bare deletes, while another writer uses the same batch number."""
    path, cut = _path(c, "pk_restart"), _at(str(CUTOFF))
    PKTable(c.spark, path, ["id"], buckets=8).write_batch(c.changes.where(F.col("ts") < cut), 0)
    t = PKTable(c.spark, path, ["id"], buckets=8)
    later = c.changes.where(_since(cut))
    t.write_batch(later.where("op = 'd'").select("op", "seq", "id"), 1, writer="deletes")
    t.write_batch(later.where("op <> 'd'"), 1)
    return t.read().select(*COLS)


@register("ticket_by_ids", sql=f"SELECT ticket_id, title, status, updated_at FROM r_tickets WHERE ticket_id IN ({IN})")
def q_ticket_by_ids(c):
    """Tickets by primary key from a keyed table of all tickets; only the buckets of the keys are read."""
    t = PKTable(c.spark, _path(c, "tickets"), ["ticket_id"], buckets=16)
    t.write_batch(c.tickets.select(F.lit("c").alias("op"), F.lit(1).alias("seq"), "*"), 0)
    return t.lookup(IDS).select("ticket_id", "title", "status", "updated_at")


@register("agents_by_ids", sql=f"SELECT agent_id, agent_name, department, status FROM r_agents WHERE agent_id IN ({IN})")
def q_agents_by_ids(c):
    """Agents by primary key; the key is an INT, as in the source system."""
    t = PKTable(c.spark, _path(c, "agents"), ["agent_id"], buckets=16)
    t.write_batch(c.agents.withColumn("agent_id", F.col("agent_id").cast("int")).select(
        F.lit("c").alias("op"), F.lit(1).alias("seq"), "*"), 0)
    return t.lookup(IDS).select(F.col("agent_id").cast("bigint").alias("agent_id"), "agent_name", "department", "status")


@register("tier_cycle", sql=f"""SELECT CASE WHEN {ARCHIVED} THEN 'cold' ELSE 'hot' END AS tier, ticket_id,
    CASE WHEN {ARCHIVED} AND priority = 'high' THEN 'closed' ELSE status END AS status,
    CAST(created_at AS DATE) AS archive_date FROM r_tickets""")
def q_tier_cycle(c):
    """Two archive cycles over all tickets: those of low priority arrive after the first one, also for days already
    archived, and archived tickets of high priority are closed between the two."""
    hot, cold = PKTable(c.spark, _path(c, "hot"), ["ticket_id"], buckets=8), _path(c, "cold")
    rows = c.tickets
    made = [F.lit("c").alias("op"), F.lit(1).alias("seq"), "*"]
    hot.write_batch(rows.where("priority <> 'low'").select(*made), 0)
    tier_cycle(hot, cold, c.events_as_of, version=0)
    old = (F.col("priority") == "high") & (F.col("created_at") < _at("2024-01-23 00:00:00"))
    closed = rows.where(old).withColumn("status", F.lit("closed")).select(F.lit("u").alias("op"), F.lit(5).alias("seq"), "*")
    hot.write_batch(rows.where("priority = 'low'").select(*made).unionByName(closed), 1)
    tier_cycle(hot, cold, c.events_as_of, version=1)

    def side(df, name):
        return df.select(F.lit(name).alias("tier"), "ticket_id", "status", F.to_date("created_at").alias("archive_date"))
    return side(hot.read(), "hot").unionByName(side(c.spark.read.parquet(cold), "cold"))
