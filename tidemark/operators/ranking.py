"""Exact global ranking without a single-partition window.

``ROW_NUMBER() / RANK() OVER (ORDER BY …)`` with no PARTITION BY makes Spark
move every row into one task. Instead:

1. ``orderBy`` range-partitions and sorts the data in parallel;
2. ``monotonically_increasing_id`` tags each row with (partition, position);
3. the tagged frame is checkpointed to the shared checkpoint folder, which
   fixes the tags and cuts lineage (survives executor loss);
4. per-partition row counts — one row per partition, a proven size bound —
   give each partition its offset, broadcast back to every row.

RANK (ties share the lowest row number) takes the minimum row number per tie
value with an aggregate, joined back on the tie columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir

_LOW_BITS = (1 << 33) - 1


def global_rank(df: DataFrame, order: list[Column], out_col: str, method: str = "row_number",
                tie_cols: list[str] | None = None) -> DataFrame:
    """Add ``out_col`` = 1-based global ROW_NUMBER or RANK over ``order``.

    ``order`` must make ROW_NUMBER deterministic (add a unique tiebreak column).
    ``tie_cols``: for RANK, the columns whose equal values share a rank.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    cols = df.columns
    tagged = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    tagged = tagged.checkpoint(eager=True)
    tagged = tagged.select(*cols, F.shiftright("_mid", 33).alias("_pid"),
                           F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)).alias("_pos"))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: the window below runs over a bounded, tiny table
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rn = tagged.join(F.broadcast(offsets), "_pid").select(
        *cols, (F.col("_off") + F.col("_pos") + 1).alias(out_col))
    if method == "row_number":
        return rn
    if method != "rank":
        raise ValueError(method)
    ties = tie_cols or []
    if not ties:
        raise ValueError("rank needs tie_cols")
    first = rn.groupBy(*[F.col(c).alias(f"_t_{c}") for c in ties]).agg(
        F.min(out_col).alias("_first"))
    cond = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in ties]
    out = rn.join(first, cond, "inner")
    return out.select(*cols, F.col("_first").alias(out_col))
