"""Plan-shape checks: no cartesian products, no single-task ranking window,
filters and column pruning reach the Parquet scan, salted detail join."""

import re

import pytest

from tidemark.operators import grid as G
from tidemark.plans.catalog import Ctx, queries

# jobs that run when called; what they return is a plain read
SKIP = {"multi_sink", "full_refresh", "product_ranking", "agent_ranking", "continuous_sync"}
SKIP |= {n for n in queries() if n.startswith("incremental_")}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in queries() if n not in SKIP))
def test_no_cartesian_or_python(spark, sf_small, name):
    plan = _plan(queries()[name](spark, sf_small))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


def test_ranking_has_no_global_window(spark, sf_small):
    for name in ("product_ranking", "agent_ranking"):
        plan = _plan(queries()[name](spark, sf_small))
        # the only window runs over per-partition counts; no rank()/row_number() window
        assert "rank(" not in plan and "row_number(" not in plan, name


def test_filter_pushdown_and_pruning(spark, sf_small):
    plan = _plan(queries()["hourly_ticket_trend"](spark, sf_small))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", plan)
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln][0]
    schema = re.search(r"ReadSchema: struct<([^>]*)>", scan).group(1)
    assert "props" not in schema and "ts" in schema


def test_partition_pruning_on_archive_date(spark, sf_small, tmp_path):
    from tidemark.operators import tier as H
    c = Ctx(spark, sf_small)
    path = str(tmp_path / "cold")
    H.write_cold(H.archive_cold(c.tickets, c.events_as_of), path)
    cold = spark.read.parquet(path)
    plan = _plan(H.partition_snapshot(cold, c.events_as_of.date().replace(day=22)))
    assert re.search(r"PartitionFilters: \[[^\]]*archive_date", plan)


def test_detail_join_is_salted_equi_join(spark, sf_small):
    c = Ctx(spark, sf_small)
    plan = _plan(G.smart_grid_detail(G.conform_dispatch(G.dispatch_source(c.dispatch)),
                                     G.conform_device(c.devices), salt=8))
    assert "CartesianProduct" not in plan and "_s" in plan


def test_hot_key_is_combined_map_side(spark, sf_small):
    """A key holding a third of the change rows is reduced per task before the
    shuffle (partial max_by), and the session splits skewed join partitions."""
    from pyspark.sql import functions as F
    from tidemark.operators.changes import apply_changes
    rows = [("u", i, 0 if i % 3 == 0 else i, f"v{i}") for i in range(3000)]
    ch = spark.createDataFrame(rows, "op string, seq long, id long, v string")
    out = apply_changes(ch, ["id"])
    plan = _plan(out)
    assert "partial_max" in plan
    assert out.where(F.col("id") == 0).collect()[0].v == "v2997"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    plan = _plan(queries()["agent_workload"](spark, sf_small))
    assert "partial_count" in plan  # tickets are pre-aggregated per agent before the join
