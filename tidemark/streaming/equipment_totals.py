"""The daily equipment summary that follows its stream of readings by signed deltas.

Means and the deviation come from exact sums (of values and of squares), which can
be taken back. What can't be taken back from a single number is kept as counts per
value: the largest and smallest measure of a day and its hours with a reading. A
reading that is corrected, moved to another day or device, or withdrawn leaves its
old values and enters its new ones; no other reading of the day is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import equipment as E
from tidemark.streaming.pktable import PKTable
from tidemark.streaming.totals import SignedSums, _Totals

KEY = ["equipment_id", "summary_date"]
#: Measure -> (decimals of a reading, decimals of its mean).
MEANS = {"voltage_avg": (2, 2), "current_avg": (2, 2), "power_active": (2, 2), "power_factor": (4, 4), "frequency": (2, 3),
         "temperature": (2, 2)}
EXTREMES = ["voltage_avg", "current_avg", "power_active", "temperature"]
HOUR = "hour"


class EquipmentDays(_Totals):
    """Reading stream -> sums and counts per value of every equipment and day."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 4):
        self.readings = PKTable(spark, f"{root}/ods_readings", ["monitoring_id"], buckets)
        sums = {f"{m}_sum": f"decimal(28,{scale})" for m, (scale, _) in MEANS.items()}
        sums |= {f"{m}_n": "bigint" for m in MEANS} | {"voltage_squares": "decimal(28,4)", "abnormal": "bigint"}
        self.days = SignedSums(spark, f"{root}/days", KEY, sums, buckets)
        self.values = SignedSums(spark, f"{root}/values", [*KEY, "measure", "value"], {}, buckets, bucket_keys=KEY)

    @staticmethod
    def _day_rows(r: DataFrame) -> DataFrame:
        exact = {m: F.col(m).cast(f"decimal(18,{scale})") for m, (scale, _) in MEANS.items()}
        volts = F.col("voltage_avg").cast("decimal(12,2)")
        return r.select(
            *KEY, F.lit(1).alias("n"), *[c.alias(f"{m}_sum") for m, c in exact.items()],
            *[c.isNotNull().cast("int").alias(f"{m}_n") for m, c in exact.items()], (volts * volts).alias("voltage_squares"),
            E.abnormal(F.col("voltage_avg"), F.col("frequency")).cast("int").alias("abnormal"))

    @staticmethod
    def _value_rows(r: DataFrame) -> DataFrame:
        seen = [F.struct(F.lit(name).alias("measure"), F.col(c).cast("double").alias("value"))
                for name, c in [*((m, m) for m in EXTREMES), (HOUR, "monitoring_hour")]]
        return r.select(*KEY, F.inline(F.array(*seen))).where("value IS NOT NULL").withColumn("n", F.lit(1))

    def _process(self, batch: DataFrame, b: int) -> None:
        facts = E.reading_facts(batch.where("tbl = 'reading'"), ["op", "seq"]).select(
            "op", "seq", "monitoring_id", "equipment_id", F.col("monitoring_date").alias("summary_date"), "monitoring_hour", *MEANS)
        before, after, changed = self._change(self.readings, facts, b)
        self.days.apply(self._day_rows(after), self._day_rows(before), b).unpersist()
        self.values.apply(self._value_rows(after), self._value_rows(before), b).unpersist()
        changed.unpersist()

    def summary(self, equipment: DataFrame) -> DataFrame:
        """The rows of ``equipment.equipment_daily_summary``."""
        of = lambda m: F.when(F.col("measure") == m, F.col("value"))
        ends = self.values.read().groupBy(*[F.col(k).alias(f"_{k}") for k in KEY]).agg(
            *[f(of(m)).alias(f"{m}_{name}") for m in EXTREMES for name, f in (("max", F.max), ("min", F.min))],
            F.count(of(HOUR)).alias("hours"))  # one row a value
        days = self.days.read()
        d = days.join(ends, [days[k].eqNullSafe(F.col(f"_{k}")) for k in KEY], "left")
        n, total = F.col("voltage_avg_n"), F.col("voltage_avg_sum").cast("decimal(18,2)")
        spread = (n.cast("decimal(12,0)") * F.col("voltage_squares").cast("decimal(25,4)") - total * total).cast("double")
        mean = lambda m: F.round(F.try_divide(f"{m}_sum", f"{m}_n"), MEANS[m][1]).cast("double")
        return E.daily_report(d.select(
            *KEY, mean("voltage_avg").alias("voltage_avg"), F.col("voltage_avg_max").alias("voltage_max"),
            F.col("voltage_avg_min").alias("voltage_min"),
            F.round(F.sqrt(F.try_divide(spread, (n * (n - 1)).cast("double"))), 4).alias("voltage_std"),
            mean("current_avg").alias("current_avg"), F.col("current_avg_max").alias("current_max"),
            F.col("current_avg_min").alias("current_min"), mean("power_active").alias("power_active_avg"),
            "power_active_max", "power_active_min", mean("power_factor").alias("power_factor_avg"),
            mean("frequency").alias("frequency_avg"), mean("temperature").alias("temperature_avg"), "temperature_max",
            F.col("n").alias("monitoring_count"), F.col("abnormal").alias("abnormal_count"),
            F.nullif(F.col("hours"), F.lit(0)).cast("double").alias("uptime_hours"),
            F.col("power_active_sum").cast("double").alias("_p_sum"), F.col("power_active_n").alias("_p_n")), equipment)
