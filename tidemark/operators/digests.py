"""Comparison of a source and a sink by content, not by counts.

Rows are digested without regard to their order: per range of keys the number
of rows and two sums of row hashes. Equal ranges agree and are done with; only
the rows of ranges that differ are read again and compared key by key, so two
tables of any size that agree cost one aggregate over each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGES = 1024  # rows of the two digest tables, and the bound of what is broadcast
MISSING, UNEXPECTED, DIFFERENT = "missing", "unexpected", "different"


def _hashed(df: DataFrame, keys: list[str], columns: list[str], ranges: int) -> DataFrame:
    """keys, the range of the key, and two hashes of the row. NULL is told from any value by its position."""
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(ranges)).alias("_range"), F.xxhash64(row).alias("_h"),
                     F.xxhash64(F.lit(1), row).alias("_g"))


def range_digests(df: DataFrame, keys: list[str], columns: list[str], ranges: int = RANGES) -> DataFrame:
    """_range, n, sum_h, sum_g: equal for two tables exactly when (but for hash collisions) their ranges hold the
    same rows equally often."""
    return _hashed(df, keys, columns, ranges).groupBy("_range").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("sum_h"),
        F.sum(F.col("_g").cast("decimal(38,0)")).alias("sum_g"))


def differing_ranges(source: DataFrame, sink: DataFrame, keys: list[str], columns: list[str], ranges: int = RANGES) -> DataFrame:
    """_range: the ranges of which source and sink do not hold the same rows."""
    a, b = (range_digests(d, keys, columns, ranges) for d in (source, sink))
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
    return both.groupBy("_range").agg(*[F.sum(F.col(c) * F.col("side")).alias(c) for c in ("n", "sum_h", "sum_g")]).where(
        "n <> 0 OR sum_h <> 0 OR sum_g <> 0").select("_range")


def differing_keys(source: DataFrame, sink: DataFrame, keys: list[str], columns: list[str] | None = None,
                   ranges: int = RANGES) -> DataFrame:
    """keys, difference, source_rows, sink_rows: every key whose rows are not the same on both sides.

    ``missing``: in the source only, ``unexpected``: in the sink only, ``different``: in both with other rows or
    another number of them. Keys may be NULL and may repeat.
    """
    columns = columns or source.columns
    wanted = F.broadcast(differing_ranges(source, sink, keys, columns, ranges))
    parts = []
    for df, side in ((source, 1), (sink, -1)):
        rows = _hashed(df, keys, columns, ranges).join(wanted, "_range", "left_semi")
        parts.append(rows.select(*keys, F.lit(side).alias("_s"), "_h", "_g"))
    signed = [F.sum(F.col(c).cast("decimal(38,0)") * F.col("_s")).alias(c) for c in ("_h", "_g")]
    per = parts[0].unionByName(parts[1]).groupBy(*keys).agg(
        F.count(F.when(F.col("_s") == 1, 1)).alias("source_rows"), F.count(F.when(F.col("_s") == -1, 1)).alias("sink_rows"), *signed)
    kind = (F.when(F.col("sink_rows") == 0, MISSING).when(F.col("source_rows") == 0, UNEXPECTED).otherwise(DIFFERENT))
    return per.where("source_rows <> sink_rows OR _h <> 0 OR _g <> 0").select(
        *keys, kind.alias("difference"), "source_rows", "sink_rows")
