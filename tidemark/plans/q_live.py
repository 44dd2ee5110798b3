"""Registered standing jobs: metrics, ranks and status that follow a stream, monitors of the running jobs, and the
comparison of a sink with its source by content (Spark job + DuckDB oracle)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import digests
from tidemark.operators import equipment as E
from tidemark.plans import q_equipment
from tidemark.plans.catalog import register
from tidemark.plans.q_streaming import FINAL_ITEMS, FINAL_TICKETS, _run
from tidemark.session import shared_path
from tidemark.sources import changes as CH
from tidemark.streaming import job_monitor as JM
from tidemark.streaming.live_status import VALUES, LiveStatus
from tidemark.streaming.partials import TICKET_COLS, ticket_metrics_job
from tidemark.streaming.rank_totals import RankedProducts


def _landed(c, changes, n_batches: int = 3, files: int = 4) -> tuple[str, str, int]:
    """The change log as files of event-time ranges: folder of the run, folder of the files, files of a range."""
    root = shared_path(c.spark, "live", uuid.uuid4().hex)
    return root, f"{root}/changes", CH.stage_change_files(changes, f"{root}/changes", n_batches, files)


@register("live_ticket_metrics", sql="""WITH by_status AS (SELECT status, count(*) AS n FROM r_final GROUP BY status)
    SELECT sum(n)::BIGINT AS total_tickets, coalesce(sum(n) FILTER (status = 'pending'), 0)::BIGINT AS pending_tickets,
    coalesce(sum(n) FILTER (status = 'in_progress'), 0)::BIGINT AS in_progress_tickets,
    coalesce(sum(n) FILTER (status = 'resolved'), 0)::BIGINT AS resolved_tickets,
    coalesce(sum(n) FILTER (status = 'closed'), 0)::BIGINT AS closed_tickets,
    (SELECT avg(date_sub('minute', created_at, closed_at)) FROM r_final) AS avg_resolution_time_minutes FROM by_status""",
          extra_ctes=FINAL_TICKETS)
def q_live_ticket_metrics(c):
    """The ticket metrics as a standing job: each micro-batch computes the partials of the buckets it touches."""
    changes = CH.ticket_change_log(c.t)
    root, path, files = _landed(c, changes)
    job = ticket_metrics_job(c.spark, root)
    job.run(CH.read_change_stream(c.spark, path, changes.schema, files).select(*TICKET_COLS), f"{root}/checkpoint")
    return job.result()


@register("incremental_product_ranking", sql="""WITH p AS (SELECT product_name, sum((quantity * unit_price)::DECIMAL(18,2)) AS s,
        sum(quantity)::BIGINT AS total_quantity, count(DISTINCT order_id) AS total_orders FROM r_final GROUP BY product_name)
    SELECT product_name, s::DOUBLE AS total_sales, total_quantity, total_orders, rank() OVER (ORDER BY s DESC) AS sales_rank FROM p""",
          extra_ctes=FINAL_ITEMS)
def q_incremental_product_ranking(c):
    """Ranks from a histogram of sales values that the item stream keeps by deltas."""
    return _run(c, RankedProducts, CH.item_versions(c.t)).ranking()


@register("live_status", sql=f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY equipment_id
        ORDER BY monitoring_time DESC, monitoring_id DESC) AS nth FROM r_dmon)
    SELECT equipment_id, monitoring_time, {', '.join(VALUES)},
    if(monitoring_time > TIMESTAMP '2024-01-30 23:49:59', 'ONLINE', 'OFFLINE') AS connection_status FROM n WHERE nth = 1""",
          extra_ctes=q_equipment.CTES)
def q_live_status(c):
    """Newest reading and connection status of every equipment from keyed state, readings out of order."""
    readings = E.reading_facts(c.monitoring).withColumns({
        "id": F.col("monitoring_id"), "seq": F.col("monitoring_id"),  # every seventh reading arrives six hours late
        "event_time": F.timestamp_add("HOUR", F.when(F.col("monitoring_id") % 7 == 0, 6).otherwise(0), F.col("monitoring_time"))})
    root, path, files = _landed(c, readings)
    live = LiveStatus(c.spark, root)
    live.start(CH.read_change_stream(c.spark, path, readings.schema, files), availableNow=True).awaitTermination()
    return live.status(c.events_as_of)


@register("source_sink_diff", sql="""SELECT id, CASE WHEN id % 1009 = 0 THEN 'missing' ELSE 'different' END AS difference,
    1::BIGINT AS source_rows, if(id % 1009 = 0, 0, if(id % 991 = 0, 2, 1))::BIGINT AS sink_rows
    FROM r_orders WHERE id % 1009 = 0 OR id % 997 = 0 OR id % 991 = 0
    UNION ALL SELECT -id, 'unexpected', 0, 1 FROM r_orders WHERE id % 983 = 0 AND id % 1009 <> 0""")
def q_source_sink_diff(c):
    """A written copy of the orders that lost some rows, changed, repeated and gained others: the keys that differ, named
    from digests; equal ranges are not read again."""
    lost, other = F.col("id") % 1009 == 0, F.col("id") % 997 == 0
    copy = c.orders.where(~lost).withColumn("order_status", F.when(other, "lost").otherwise(F.col("order_status")))
    more = F.array_compact(F.array(F.lit(1), F.when(F.col("id") % 991 == 0, 2), F.when(F.col("id") % 983 == 0, 3)))
    copy = copy.withColumn("k", F.explode(more)).withColumn("id", F.when(F.col("k") == 3, -F.col("id")).otherwise(F.col("id"))).drop("k")
    path = shared_path(c.spark, "sink-copy", uuid.uuid4().hex)
    copy.write.parquet(path)
    return digests.differing_keys(c.orders, c.spark.read.schema(copy.schema).parquet(path), ["id"])


@register("stream_batches", sql="""SELECT 'tickets' AS query, 2 * count(*) AS total_rows, count(*) FILTER (updated_at IS NULL) AS rows_without_time,
    least(min(created_at), min(updated_at)) AS oldest_event, greatest(max(created_at), max(updated_at)) AS newest_event FROM r_tickets""")
def q_stream_batches(c):
    """What a running ingest says of its own micro-batches, added up: rows and event times by observed metrics."""
    changes = CH.ticket_change_log(c.t)
    root, path, files = _landed(c, changes)
    stream = JM.observed(CH.read_change_stream(c.spark, path, changes.schema, files), "event_time")
    q = (stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return JM.batches_of(c.spark, q, "tickets").groupBy("query").agg(
        F.sum("rows").alias("total_rows"), F.sum("rows_without_time").alias("rows_without_time"),
        F.min("oldest_event").cast("timestamp_ntz").alias("oldest_event"), F.max("newest_event").cast("timestamp_ntz").alias("newest_event"))
