"""Mixing sources to target weights by Pareto order sampling.

1. Targets: sources share ``budget`` by weight; a source's target stops at
   ``max_copies`` times its size and the excess goes to the others by weight.
2. Expected copies of a document are ``min(max_copies, c * g)``, where g is
   its propensity and c is set per source so that expected words equal the
   target. Their whole part is allocated for certain.
3. The fractional part is an inclusion probability. Documents are ranked by
   random odds divided by inclusion odds (Pareto order sampling) and taken in
   that order as long as they fit into the source's remaining words, so the
   sample has a fixed size in words. The one document whose size comes
   nearest to what is then left closes the gap, if it makes it smaller.

No source is ever gathered in one task: words are first summed over bins of
the rank (two levels, 4096 bins each), and only the rows of the one bin in
which the target falls, about one in 16 million, are put in order.
The random number is a digest of seed and document id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, word_count, written

BINS = 4096
SEED = "mix-1"
_TOP = float(1 << 52)


def size_class(size: Column) -> Column:
    """Number of binary digits of the size (1 for 0 and 1)."""
    return F.length(F.bin(size))


def default_propensity(size: Column) -> Column:
    """Longer documents are somewhat likelier: 1 + (binary digits of the size) / 32, an exact binary fraction."""
    return 1 + size_class(size) / F.lit(32.0)


def weighted_targets(sources: DataFrame, budget: Column | None = None, max_copies: int = 3) -> DataFrame:
    """``sources`` (source, source_size, weight) plus ``target``: one row per source, water-filled.

    With everything capped before the budget is used up, every source gets its cap.
    """
    order = Window.orderBy("fill", F.col("source").isNull(), "source")
    rows = sources.withColumn("cap", max_copies * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(Window.partitionBy()) if budget is None else budget
    rows = (rows.withColumn("total", total)
            .withColumn("capped_before", F.coalesce(F.sum("cap").over(order.rowsBetween(
                Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left")))
    # the first source whose cap is not below the level fixes the level for all after it
    rows = rows.withColumn("final", F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "level"))).over(
        Window.partitionBy())["level"])
    return rows.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(
        F.col("final"), F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "weight", "target")


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .. ``cycle``, repeating, by the source's code points, null last."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    return sources.withColumn("weight", (F.row_number().over(order) - 1) % cycle + 1)


def _rates(classes: DataFrame, max_copies: int) -> DataFrame:
    """Per source the factor c with sum(words * min(max_copies, c * g)) = target.

    ``classes`` has one row per source and propensity. Propensities are walked
    from the largest; those at or above the cap take ``max_copies``.
    """
    down = Window.partitionBy("source").orderBy(F.col("g").desc())
    c = classes.withColumn("above", F.coalesce(F.sum("words").over(down.rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("mass", F.sum(F.col("words") * F.col("g")).over(down.rowsBetween(0, Window.unboundedFollowing)))
    c = c.withColumn("c", F.when(F.col("mass") > 0, (F.col("target") - max_copies * F.col("above")) / F.col("mass")))
    # valid where the largest free propensity is not over the cap; the first such class is the solution
    return c.where(F.col("c").isNotNull() & (F.col("c") * F.col("g") <= max_copies)).groupBy("source").agg(
        F.max(F.struct("g", "c")).alias("s")).select("source", F.col("s.c").alias("c"))


def uniform(seed: str, key: Column) -> Column:
    """A number in (0, 1) from a digest of seed and key: 52 bits of MD5, shifted off both ends."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / _TOP


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: DataFrame | None = None, propensity=default_propensity, max_copies: int = 3,
        seed: str = SEED, bins: int = BINS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, weight, target, expected, copies, taken.

    ``weights`` (source, weight) defaults to 1, 2, 3, repeating. Null text has
    size 0; a null source is a source of its own, last in order. A document of
    size 0 gets no copies. Rows that
    repeat an id share its random number and are ranked next to one another.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = word_count(F.col("t"))
    rows = written(docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"),
                               docs[text_col].alias("t")).select(
        "doc_id", "source", size.alias("size"), F.monotonically_increasing_id().alias("uid")),
                   scratch(spark, "mix-sizes"))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = cyclic_weights(sources) if weights is None else sources.join(
        weights.toDF("w_source", "weight"), F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    targets = written(weighted_targets(weighed, max_copies=max_copies), scratch(spark, "mix-targets"))

    def by_source(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
        right = right.withColumnRenamed("source", "_s")
        return left.join(right, F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")

    classes = by_source(rows.withColumn("g", propensity(F.col("size"))).groupBy("source", "g").agg(
        F.sum("size").alias("words")), targets.select("source", "target"))
    plan = written(by_source(targets, _rates(classes, max_copies)), scratch(spark, "mix-plan"))
    g = propensity(F.col("size"))
    drawn = by_source(rows, plan).withColumn("expected", F.least(
        F.lit(float(max_copies)), F.greatest(F.lit(0.0), F.coalesce("c", F.lit(float(max_copies))) * g)))
    drawn = drawn.withColumn("expected", F.when(F.col("size") > 0, F.col("expected")).otherwise(0.0))
    drawn = drawn.withColumn("sure", F.floor("expected")).withColumn("lam", F.col("expected") - F.col("sure"))
    u = uniform(seed, F.col("doc_id"))
    drawn = drawn.withColumn("rank", F.when(F.col("lam") > 0, (u / (1 - u)) / (F.col("lam") / (1 - F.col("lam")))))
    # the rank falls into a bin by rank / (1 + rank), which lies in (0, 1) and keeps the order
    drawn = drawn.withColumn("spot", F.col("rank") / (1 + F.col("rank")))
    drawn = drawn.withColumn("bin", F.least(F.floor(F.col("spot") * bins), F.lit(bins - 1)).cast("int"))
    drawn = drawn.withColumn("bin2", F.least(F.floor((F.col("spot") * bins - F.col("bin")) * bins),
                                             F.lit(bins - 1)).cast("int"))

    sure = drawn.groupBy("source").agg(F.sum(F.col("size") * F.col("sure")).alias("sure_words"))
    left = by_source(plan.select("source", "target"), sure).select(
        "source", (F.col("target") - F.coalesce("sure_words", F.lit(0))).alias("room"))
    cells = written(drawn.where("lam > 0").groupBy("source", "bin", "bin2").agg(F.sum("size").alias("words")),
                    scratch(spark, "mix-cells"))

    def crossing(parts: DataFrame, start: DataFrame, key: str) -> DataFrame:
        """Per source the first ``key`` whose running words reach the room, and the words before it."""
        run = F.sum("words").over(Window.partitionBy("source").orderBy(key).rowsBetween(
            Window.unboundedPreceding, 0))
        seen = by_source(parts, start).withColumn("upto", run)
        return seen.where("upto >= room").groupBy("source").agg(F.min(F.struct(
            F.col(key), (F.col("room") - F.col("upto") + F.col("words")).alias("rest"))).alias("x")).select(
            "source", F.col(f"x.{key}").alias(key), F.col("x.rest").alias("room"))

    first = crossing(cells.groupBy("source", "bin").agg(F.sum("words").alias("words")), left, "bin")
    in_bin = by_source(cells, first.withColumnRenamed("bin", "cut").select("source", "cut"), "inner").where(
        "bin = cut").drop("cut", "bin")
    second = crossing(in_bin, first.select("source", "room"), "bin2")
    cut = written(by_source(first.select("source", F.col("bin").alias("cut1")),
                            second.select("source", F.col("bin2").alias("cut2"), "room")), scratch(spark, "mix-cut"))

    placed = by_source(drawn, cut)
    edge = placed.where("lam > 0 and bin = cut1 and bin2 = cut2")
    run = F.sum("size").over(Window.partitionBy("source").orderBy("rank", F.col("doc_id").isNull(), "doc_id", "uid")
                             .rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("extra", F.when(run <= F.col("room"), 1).otherwise(0))
    inner = placed.where("not (lam > 0 and coalesce(bin = cut1 and bin2 = cut2, false))").withColumn(
        "extra", F.when((F.col("lam") > 0) & (
            F.col("cut1").isNull() | (F.col("bin") < F.col("cut1"))
            | ((F.col("bin") == F.col("cut1")) & (F.col("bin2") < F.col("cut2")))), 1).otherwise(0))
    cols = ["uid", "doc_id", "source", "size", "source_size", "weight", "target", "expected", "sure", "extra", "rank"]
    taken = written(inner.select(cols).unionByName(edge.select(cols)), scratch(spark, "mix-taken"))
    gaps = taken.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("size") * (F.col("sure") + F.col("extra")))).alias("gap"))
    miss = F.abs(F.col("size") - F.col("gap"))
    close = by_source(taken.where("rank is not null and extra = 0 and size > 0"), gaps).where(
        miss < F.col("gap")).groupBy("source").agg(F.min(F.struct(
            miss.alias("miss"), F.col("rank"), F.col("doc_id"), F.col("uid"))).alias("x")).select(
        "source", F.col("x.uid").alias("closing"))
    copies = F.col("sure") + F.col("extra") + F.when(F.col("uid") == F.col("closing"), 1).otherwise(0)
    return by_source(taken, close).withColumn("copies", copies.cast("int")).select(
        "doc_id", "source", "size", "source_size", "weight", "target", "expected", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"))
