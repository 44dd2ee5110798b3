"""Hot/cold tiering of the live ticket table.

The hot tier is the live (PK) ticket table; the cold tier is a Parquet table
partitioned by ``archive_date`` (= created date, SURVEY §2.13 #15). Every cold
read filters ``archive_date`` so Spark prunes partitions (and uses dynamic
pruning when the date comes from a join). Commit order for the batch job:
``archive_cold`` → verify counts → ``expire_hot``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.operators.tickets import since_day, ts_lit

TICKET_COLS = ["ticket_id", "customer_id", "agent_id", "title", "priority", "status", "category",
               "created_at", "updated_at", "closed_at"]
# Fixed labels of the tier summaries and the seeded agent name.
HOT_LABEL = "实时层"
COLD_LABEL = "历史存储层"
HOT_RECENT_LABEL = "实时数据"
COLD_HISTORY_LABEL = "历史数据"
HISTORY_AGENT = "历史客服"


def _d(day: dt.date) -> F.Column:
    return F.lit(day.isoformat()).cast("date")


def archive_cold(tickets: DataFrame, as_of: dt.datetime, hot_days: int = 7) -> DataFrame:
    """Rows created before (today − hot_days) with archive_date = created date."""
    cutoff = as_of.date() - dt.timedelta(days=hot_days)
    old = tickets.where(~since_day(F.col("created_at"), cutoff))
    return old.select(*TICKET_COLS, F.to_date("created_at").alias("archive_date"))


def archive_incremental(tickets: DataFrame, cold: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Today's rows not yet archived under today's partition (NOT IN → left_anti
    on a non-null key; only the one partition of the cold table is read)."""
    today = as_of.date()
    lo = F.lit(today.strftime("%Y-%m-%d 00:00:00")).cast("timestamp_ntz")
    hi = F.timestamp_add("DAY", F.lit(1), lo)
    todays = tickets.where((F.col("created_at") >= lo) & (F.col("created_at") < hi))
    done = cold.where(F.col("archive_date") == _d(today)).select("ticket_id")
    return todays.join(done, "ticket_id", "left_anti").select(
        *TICKET_COLS, F.to_date("created_at").alias("archive_date"))


def expire_hot(tickets: DataFrame, as_of: dt.datetime, hot_days: int = 7) -> DataFrame:
    """The hot table after expiry: rows created on or after (today − hot_days)."""
    cutoff = as_of.date() - dt.timedelta(days=hot_days)
    return tickets.where(since_day(F.col("created_at"), cutoff))


def _tier_summary(df: DataFrame, label: str, end_col: F.Column) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("ticket_count"),
        R.count_if(F.col("status") == "resolved").alias("resolved_count"),
        F.avg(F.timestamp_diff("HOUR", F.col("created_at"), end_col)).alias("avg_resolution_hours"),
    ).select(F.lit(label).alias("data_source"), "*")


def hot_cold_summary(hot: DataFrame, cold: DataFrame, as_of: dt.datetime, days: int = 3) -> DataFrame:
    """Hot rows of the last ``days`` days (open tickets measured to now) and cold
    partitions older than that (open tickets measured to updated_at)."""
    cut = as_of.date() - dt.timedelta(days=days)
    h = _tier_summary(hot.where(since_day(F.col("created_at"), cut)), HOT_RECENT_LABEL,
                      F.coalesce(F.col("closed_at"), ts_lit(as_of)))
    c = _tier_summary(cold.where(F.col("archive_date") < _d(cut)), COLD_HISTORY_LABEL,
                      F.coalesce(F.col("closed_at"), F.col("updated_at")))
    return h.unionByName(c)


def unified_tier_query(hot: DataFrame, cold: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Hot (created ≥ today−days) UNION ALL cold (archive_date < today−days): disjoint."""
    cut = as_of.date() - dt.timedelta(days=days)
    h = _tier_summary(hot.where(since_day(F.col("created_at"), cut)), HOT_LABEL,
                      F.coalesce(F.col("closed_at"), ts_lit(as_of)))
    c = _tier_summary(cold.where(F.col("archive_date") < _d(cut)), COLD_LABEL,
                      F.coalesce(F.col("closed_at"), F.col("updated_at")))
    return h.unionByName(c)


def seed_state_from_history(cold: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Agent performance rebuilt from the last ``days`` days of cold partitions.

    resolution_rate is stored 0–1 like the streaming job (SURVEY §2.13 #13)."""
    since = as_of.date() - dt.timedelta(days=days)
    c = cold.where(F.col("agent_id").isNotNull() & (F.col("archive_date") >= _d(since)))
    g = c.groupBy("agent_id", F.col("archive_date").alias("stat_date")).agg(
        F.count(F.lit(1)).alias("tickets_handled"),
        R.count_if(F.col("status") == "resolved").alias("tickets_resolved"),
        F.avg(F.timestamp_diff("HOUR", F.col("created_at"),
                               F.coalesce(F.col("closed_at"), F.col("updated_at"))))
        .alias("avg_resolution_time_hours"))
    return g.select("agent_id", F.lit(HISTORY_AGENT).alias("agent_name"), "stat_date",
                    "tickets_handled", "tickets_resolved",
                    (F.col("tickets_resolved").cast("double") / F.col("tickets_handled"))
                    .alias("resolution_rate"), "avg_resolution_time_hours")


def partition_snapshot(cold: DataFrame, day: dt.date) -> DataFrame:
    """Counts of one archive partition (partition-pruned read)."""
    p = cold.where(F.col("archive_date") == _d(day))
    return p.groupBy("archive_date").agg(
        F.count(F.lit(1)).alias("daily_tickets"),
        R.count_if(F.col("status") == "resolved").alias("resolved_tickets"),
        R.count_if(F.col("priority") == "high").alias("high_priority_tickets"))


def tier_counts(hot: DataFrame, cold: DataFrame) -> DataFrame:
    def one(df, tier):
        return df.agg(F.count(F.lit(1)).alias("total_tickets"),
                      R.count_if(F.col("status") == "resolved").alias("resolved_tickets")) \
            .select(F.lit(tier).alias("tier"), "*")
    return one(hot, "hot").unionByName(one(cold, "cold"))


def merge_cold(existing: DataFrame | None, fresh: DataFrame, key: str = "ticket_id") -> DataFrame:
    """The full content of every archive date that ``fresh`` touches: rows already
    archived there and the fresh ones; of one key the fresh row counts."""
    if existing is None:
        return fresh
    kept = (existing.join(fresh.select("archive_date").distinct(), "archive_date", "left_semi")
            .join(fresh.select(key), key, "left_anti"))
    return kept.select(*fresh.columns).unionByName(fresh)


def write_cold(rows: DataFrame, path: str) -> None:
    """Replace the archive dates of ``rows`` (dynamic partition overwrite); ``rows`` must be
    their full content, see ``merge_cold``. A busy day is split over several writers."""
    (rows.hint("rebalance", "archive_date").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("archive_date").parquet(path))
