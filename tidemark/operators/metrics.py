"""Metric-row helpers: one-pass aggregates reshaped into (metric_name, metric_value) rows.

The reference builds dashboards as a UNION ALL of N scans of the same table;
here each input table is scanned once and the one-row result is unpivoted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_rows(one_row: DataFrame, names: list[str], value_type: str = "double") -> DataFrame:
    """Unpivot the columns ``names`` of a one-row aggregate into metric rows."""
    cast = one_row.select(*[F.col(n).cast(value_type).alias(n) for n in names])
    return cast.unpivot([], names, "metric_name", "metric_value")
