"""Connected components by alternating large-star and small-star steps.

Edges are rows (u, v) of longs. Each step is one grouping and one join on the
node; every intermediate edge table is written to the shared folder, so a lost
executor costs one step. A node with very many neighbours only ever meets a
one-row-per-node minimum table, which AQE splits as a skewed join; no
neighbour list is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, scratch, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least node around u."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("node"), F.least("u", "m").alias("m"))
    return (near.where("v > u").join(least, F.col("u") == F.col("node"))
            .where("v <> m").select(F.col("m").alias("u"), "v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of v, and v itself, is linked to the least of them (u < v holds)."""
    least = edges.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "node")
    hung = edges.join(least, F.col("v") == F.col("node"))
    return (hung.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
            .unionByName(least.select(F.col("m").alias("u"), F.col("node").alias("v"))).distinct())


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns node, component (least node that can be reached). Loops and repeated edges are allowed.

    Only nodes with an edge to another node come out; an empty edge table
    gives an empty result.
    """
    spark = edges.sparkSession
    path = scratch(spark, "edges")
    e = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                .distinct(), path)
    before = _state(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        large, small = scratch(spark, "large-star"), scratch(spark, "small-star")
        e = written(_small_star(written(_large_star(e), large)), small)
        after = _state(e)
        discard(spark, path, large)
        path = small
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    # settled: every edge joins a component's least node with a member
    members = e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
