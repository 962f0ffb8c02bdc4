"""Time series without gaps: sums by key and step, with a row for every step from a key's first to its last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(rows: DataFrame, keys: list[str], at: str, values: dict[str, Column], step: str = "1 day") -> DataFrame:
    """``values`` aggregated by keys and the date ``at``; steps without rows are 0.

    The steps of a key come from its own ends, so nothing is joined but aggregates.
    """
    each = rows.groupBy(*keys, at).agg(*[v.cast("bigint").alias(n) for n, v in values.items()])
    ends = each.groupBy(*keys).agg(F.min(at).alias("_low"), F.max(at).alias("_high"))
    steps = ends.select(*keys, F.explode(F.expr(f"sequence(_low, _high, interval {step})")).alias(at))
    return steps.join(each, [*keys, at], "left").select(*keys, at, *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in values])
