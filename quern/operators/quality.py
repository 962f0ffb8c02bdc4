"""Data-quality checks and grades, detectors, and period-over-period insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import bps, letter_grade


def _graded(df: DataFrame, observed: Column, limit: Column) -> DataFrame:
    """Failure fraction of ``limit``, its grade and whether it passes; a limit of zero tolerates nothing."""
    f = F.when(limit > 0, observed / F.nullif(limit, F.lit(0.0))).otherwise(F.when(observed == 0, 0.0).otherwise(float("inf")))
    return df.withColumn("fraction", F.round(F.least(f, F.lit(9.9999)), 4)).withColumn("grade", letter_grade(f)).withColumn("passing", f <= 1.0)


def freshness(df: DataFrame, keys: list[str], at: str, as_of: str, max_age_minutes: float) -> DataFrame:
    out = df.groupBy(*keys).agg(F.max(at).alias("newest"))
    age = (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("newest").cast("timestamp"))) / 60.0
    return _graded(out.withColumn("observed", F.round(age, 4)), age, F.lit(float(max_age_minutes)))


def completeness(df: DataFrame, keys: list[str], columns: list[str], max_ratio: float) -> DataFrame:
    """Null ratio of each column, graded; all columns in one pass."""
    out = df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])
    out = out.select(*keys, "rows", F.inline(items))
    ratio = F.col("nulls") / F.col("rows")
    return _graded(out.withColumn("observed", F.round(ratio, 6)), ratio, F.lit(float(max_ratio)))


def validity(df: DataFrame, keys: list[str], rules: dict[str, Column], max_ratio: float) -> DataFrame:
    """Share of rows that break each rule (null counts as broken), graded."""
    out = df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()])
    out = out.select(*keys, "rows", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("broken")) for r in rules])))
    ratio = F.col("broken") / F.col("rows")
    return _graded(out.withColumn("observed", F.round(ratio, 6)), ratio, F.lit(float(max_ratio)))


def reconciliation(left: DataFrame, right: DataFrame, keys: list[str], max_delta: float) -> DataFrame:
    """Row counts of two stores by key, their difference graded against a tolerance."""
    a = left.groupBy(*keys).agg(F.count("*").alias("left_rows"))
    b = right.groupBy(*keys).agg(F.count("*").alias("right_rows"))
    zero = F.lit(0).cast("bigint")
    out = a.join(b, keys, "full_outer").withColumn("left_rows", F.coalesce("left_rows", zero)).withColumn("right_rows", F.coalesce("right_rows", zero))
    delta = F.abs(F.col("left_rows") - F.col("right_rows"))
    return _graded(out.withColumn("observed", delta), delta.cast("double"), F.lit(float(max_delta)))


# Limits of the detectors, in basis points, and the least number of orders they need.
DETECTORS = {"rto_risk": 300, "realization_gap": 6000, "margin_erosion": 1000, "scale_opportunity": 2000}
LEAST_ORDERS = 20


def detect(kpis: DataFrame) -> DataFrame:
    """Kpis (orders, rto_orders, provisional_minor, unsettled_minor, net_minor, cm2_minor) with the signals that fire."""
    enough = F.col("orders") >= LEAST_ORDERS
    rates = {
        "rto_risk": (bps(F.col("rto_orders"), F.col("orders")), ">="),
        "realization_gap": (bps(F.col("unsettled_minor"), F.col("provisional_minor")), ">="),
        "margin_erosion": (bps(F.col("cm2_minor"), F.col("net_minor")), "<"),
        "scale_opportunity": (bps(F.col("cm2_minor"), F.col("net_minor")), ">="),
    }
    items = []
    for name, (rate, way) in rates.items():
        fires = rate >= DETECTORS[name] if way == ">=" else rate < DETECTORS[name]
        items.append(F.struct(F.lit(name).alias("signal"), rate.alias("observed_bps"), F.coalesce(enough & fires, F.lit(False)).alias("fires")))
    keep = [c for c in kpis.columns if c not in ("orders", "rto_orders", "provisional_minor", "unsettled_minor", "net_minor", "cm2_minor")]
    return kpis.select(*keep, F.inline(F.array(*items)))


def period_over_period(df: DataFrame, keys: list[str], at: str, amount: str, as_of: str, days: int) -> DataFrame:
    """This period's and the one before's counts and sums in one scan, with changes in basis points."""
    end = F.lit(as_of).cast("timestamp")
    step = F.make_dt_interval(F.lit(days))
    now = (F.col(at) >= end - step) & (F.col(at) < end)
    was = (F.col(at) >= end - step - step) & (F.col(at) < end - step)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col(amount))), F.lit(0)).cast("bigint")
    out = df.where(now | was).groupBy(*keys).agg(
        F.count_if(now).alias("orders"), F.count_if(was).alias("orders_before"), total(now).alias("amount_minor"), total(was).alias("amount_before_minor")
    )
    change = bps(F.col("amount_minor") - F.col("amount_before_minor"), F.col("amount_before_minor"))
    kind = F.when(change.isNull(), "new").when(change <= -2000, "drop").when(change >= 2000, "rise").otherwise("steady")
    return out.withColumn("change_bps", change).withColumn("insight", kind)
