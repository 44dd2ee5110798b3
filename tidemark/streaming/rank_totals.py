"""Ranks that follow a change stream: a histogram of values kept by signed deltas.

The rank of a value is one more than the number of rows with a better value. A
micro-batch moves the rows it changes from their old value to their new one, two
counts each; no row that the batch does not touch is read or sorted. When ranks
are read, the counts of the values are summed from the best down, in two steps:
per bin of values (a bounded number), then within a bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.streaming.totals import MONEY, ProductTotals, SignedSums

BINS = 256  # cut points of the value bins, which are held on the driver, and rows of the bin sums


def ranks_of(counts: DataFrame, value: str, n: str = "n", bins: int = BINS) -> DataFrame:
    """``value`` and its ``rank`` (1 is the largest value) from the number of rows of each value; NULL ranks last."""
    number = F.col(value).cast("double")
    shares = [i / bins for i in range(1, bins)]
    # the cuts only balance the bins: any of them give the same ranks
    cuts = sorted(set(counts.select(number.alias("v")).where("v IS NOT NULL").approxQuantile("v", shares, 0.001))) if shares else []
    # bins from the best down; NULL after all others
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c >= number)) if cuts else F.lit(0)
    binned = counts.withColumn("_bin", F.when(F.col(value).isNull(), len(cuts) + 1).otherwise(above))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # one row a bin
    offsets = binned.groupBy("_bin").agg(F.sum(n).alias("_n")).select("_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_bin").orderBy(F.col(value).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return binned.join(F.broadcast(offsets), "_bin").select(
        value, (1 + F.col("_off") + F.coalesce(F.sum(n).over(within), F.lit(0))).cast("bigint").alias("rank"))


class RankedProducts(ProductTotals):
    """Order item stream -> product stats and the rank of every product by its sales."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 4):
        super().__init__(spark, root, buckets)
        self.values = SignedSums(spark, f"{root}/sales_values", ["sales"], {}, buckets)

    def _changed_products(self, touched: DataFrame, b: int) -> None:
        old, new = F.col("sales") - F.col("d_sales"), F.col("sales")
        moves = F.array(F.struct(old.cast(MONEY).alias("sales"), F.when(F.col("n_before") > 0, -1).otherwise(0).alias("n")),
                        F.struct(new.cast(MONEY).alias("sales"), F.when(F.col("n") > 0, 1).otherwise(0).alias("n")))
        signed = touched.select(F.explode(moves).alias("m")).select("m.*").where("n <> 0")
        self.values.add(signed.select("sales", F.col("n").cast("bigint").alias("n")), b)

    def ranking(self) -> DataFrame:
        """The columns of ``orders.product_ranking`` but the run time."""
        ranks = ranks_of(self.values.read(), "sales").withColumnRenamed("sales", "_v")
        p = self.products.read()
        return p.join(ranks, p.sales.eqNullSafe(ranks["_v"])).select(
            "product_name", F.col("sales").cast("double").alias("total_sales"), F.col("quantity").alias("total_quantity"),
            F.col("orders").alias("total_orders"), F.col("rank").alias("sales_rank"))
