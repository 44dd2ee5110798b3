"""Registered sink queries: each writes through the sink operator into a fresh
folder under the shared checkpoint folder and reads the written result back."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tidemark.operators import grid as G
from tidemark.plans import q_grid
from tidemark.plans.catalog import register
from tidemark.session import shared_path
from tidemark.streaming import sinks as K

CTES = dict(q_grid.CTES)


@register("multi_sink", sql="""SELECT 'device_status' AS sink, summary_id AS row_id, location AS place, status AS label,
        round(efficiency, 6) AS measure, update_time AS at FROM r_dss
    UNION ALL SELECT 'grid_metrics', metric_id, grid_region, CAST(total_devices AS VARCHAR), avg_load_factor, update_time FROM r_rm
    UNION ALL SELECT 'grid_report', report_id, grid_region, reliability_rating, cost_benefit_analysis, report_time
        FROM r_rr""", extra_ctes=CTES)
def q_multi_sink(c):
    """One device batch, delivered twice, into three result tables in one unit; all written rows are read back."""
    spark, a = c.spark, c.events_as_of
    base = shared_path(spark, "multi_sink", uuid.uuid4().hex)
    outs = {"device_status": (lambda d: G.device_status_summary(d, a), "summary_id location status efficiency update_time"),
            "grid_metrics": (lambda d: G.region_metrics(d, a), "metric_id grid_region total_devices avg_load_factor update_time"),
            "grid_report": (lambda d: G.region_report(d, a),
                            "report_id grid_region reliability_rating cost_benefit_analysis report_time")}
    for _ in range(2):
        K.multi_sink(c.devices, 0, [K.parquet_sink(f"{base}/{k}", f) for k, (f, _) in outs.items()])

    def rows(k, cols):
        row_id, place, label, measure, at = (F.col(x) for x in cols.split())
        return spark.read.parquet(f"{base}/{k}").select(
            F.lit(k).alias("sink"), row_id.alias("row_id"), place.alias("place"), label.cast("string").alias("label"),
            F.round(measure, 6).alias("measure"), at.alias("at"))
    parts = [rows(k, cols) for k, (_, cols) in outs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("continuous_sync", sql="SELECT * FROM r_logs")
def q_continuous_sync(c):
    """A standing copy of the ticket log: started, stopped, and started again from its checkpoint after more files came;
    what the first run copied is not copied again."""
    spark = c.spark
    base = shared_path(spark, "continuous_sync", uuid.uuid4().hex)
    late = F.col("created_at") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    for rows in (c.logs.where(~late), c.logs.where(late)):
        rows.write.mode("append").parquet(f"{base}/source")
        stream = spark.readStream.schema(c.logs.schema).parquet(f"{base}/source")
        K.continuous_sync(stream, f"copy-{uuid.uuid4().hex[:8]}", K.parquet_sink(f"{base}/copy"), f"{base}/checkpoint",
                          available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/copy").select(*c.logs.columns)


@register("full_refresh", sql="SELECT * FROM r_rm", extra_ctes=CTES)
def q_full_refresh(c):
    """Two refresh rounds of the region metrics, the first of another day; readers see the newest alone."""
    spark = c.spark
    base = shared_path(spark, "full_refresh", uuid.uuid4().hex)
    K.full_refresh(G.region_metrics(c.devices, dt.datetime(2000, 1, 1)), base, 1)
    K.full_refresh(G.region_metrics(c.devices, c.events_as_of), base, 2)
    return K.read_latest(spark, base)


@register("prefix_refresh", sql=q_grid._status_sql("SYNC_", q_grid.LOAD_GUARDED, "efficiency_rate * 100",
                                                    q_grid.TS) + " UNION ALL SELECT * FROM r_dss",
          extra_ctes=CTES)
def q_prefix_refresh(c):
    """A sink holding CDC_ and stale SYNC_ rows; the sync job replaces the SYNC_ rows."""
    a = c.events_as_of
    stale = G.device_status_sync(c.devices, a).withColumn("efficiency", F.lit(0.0))
    existing = G.device_status_summary(c.devices, a).unionByName(stale)
    return K.prefix_refresh(existing, G.device_status_sync(c.devices, a), "summary_id", "SYNC_")
