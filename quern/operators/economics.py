"""Exact integer money: apportioning, proration, dated cost lookups and margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIG = "decimal(38,0)"


def _whole_part(product: Column, divisor: Column) -> Column:
    """Integer quotient of decimals of 38 digits, toward zero."""
    return ((product - product % divisor) / divisor).cast("bigint")


def apportion(rows: DataFrame, keys: list[str], total: str, weight: str, order: list[Column], name: str) -> DataFrame:
    """Split ``total`` (the same on all rows of a key) by weight so that the parts add up to it exactly.

    Largest remainder: whole parts first, then one unit more for the largest remainders, ties by
    ``order``; the sign is the total's. Without any weight all goes to the first row.
    """
    group = Window.partitionBy(*keys)
    w = F.sum(F.col(weight)).over(group)
    some = w > 0
    product = F.abs(F.col(total).cast(BIG)) * F.col(weight).cast(BIG)
    safe = F.when(some, w).otherwise(F.lit(1)).cast(BIG)
    part = F.when(some, _whole_part(product, safe)).otherwise(F.lit(0)).cast("bigint")
    rows = rows.withColumn("_part", part).withColumn("_rest", F.when(some, product % safe).otherwise(F.lit(0).cast(BIG)))
    rows = rows.withColumn("_left", F.abs(F.col(total)) - F.sum("_part").over(group)).withColumn("_some", some)
    place = F.row_number().over(group.orderBy(F.desc("_rest"), *order))
    rows = rows.withColumn("_place", place)
    more = F.when(F.col("_some"), (F.col("_place") <= F.col("_left")).cast("bigint")).otherwise(F.when(F.col("_place") == 1, F.col("_left")).otherwise(0))
    out = rows.withColumn(name, (F.signum(F.col(total).cast("double")).cast("bigint") * (F.col("_part") + more)).cast("bigint"))
    return out.drop("_part", "_rest", "_left", "_some", "_place")


def apportion_to_top(rows: DataFrame, keys: list[str], total: str, weight: str, order: list[Column], name: str) -> DataFrame:
    """Split by integer-divided weight; what is left goes to the first row in ``order``."""
    group = Window.partitionBy(*keys)
    rows = rows.withColumn("_w", F.sum(F.col(weight)).over(group))
    product = F.col(total).cast(BIG) * F.col(weight).cast(BIG)
    part = F.when(F.col("_w") != 0, _whole_part(product, F.nullif(F.col("_w"), F.lit(0)).cast(BIG))).otherwise(F.lit(0))
    rows = rows.withColumn("_p", part.cast("bigint"))
    left = F.col(total) - F.sum("_p").over(group)
    first = F.row_number().over(group.orderBy(*order)) == 1
    return rows.withColumn(name, (F.col("_p") + F.when(first, left).otherwise(0)).cast("bigint")).drop("_w", "_p")


def dated_lookup(rows: DataFrame, bands: DataFrame, keys: list[str], at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows with the columns of the half-open band of their keys that holds their time (left join).

    Bands of a key don't overlap. The keys make the join; the range is a residual condition.
    """
    b = bands.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = (F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(end) > F.col(at)))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return rows.join(b, on, "left").drop(*[f"_{k}" for k in keys])


def margins(orders: DataFrame) -> DataFrame:
    """CM1 to CM3 from net, cogs, shipping, packaging, fees and marketing, in minor units."""
    cm1 = F.col("net_minor") - F.col("cogs_minor")
    cm2 = cm1 - F.col("shipping_minor") - F.col("packaging_minor") - F.col("fee_minor")
    return orders.withColumn("cm1_minor", cm1).withColumn("cm2_minor", cm2).withColumn("cm3_minor", cm2 - F.col("marketing_minor"))


def unpivot_amounts(rows: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """One row per key and named amount that isn't null or zero."""
    items = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("amount_minor")) for kind, c in columns.items()])
    return rows.select(*keys, F.inline(items)).where(F.coalesce(F.col("amount_minor"), F.lit(0)) != 0)
