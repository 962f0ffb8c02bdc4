"""Shared shapes of the marts: cohorts, histograms with zero fill, funnels, top-N, modes, affinity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import bps, ladder


def month_index(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def cohort_members(orders: DataFrame, keys: list[str], customer: str, at: str, amount: str) -> DataFrame:
    """Customer by months since the first order: orders and amount; cohort is the first order's month.

    One shuffle on the customer serves the window and the group.
    """
    w = Window.partitionBy(*keys, customer)
    first = F.min(at).over(w)
    rows = orders.withColumn("cohort_month", F.date_format(first, "yyyy-MM")).withColumn("period_index", month_index(F.col(at)) - month_index(first))
    return rows.groupBy(*keys, customer, "cohort_month", "period_index").agg(F.count("*").alias("orders"), F.sum(amount).cast("bigint").alias("amount_minor"))


def cohort_sizes(members: DataFrame, keys: list[str], customer: str) -> DataFrame:
    return members.groupBy(*keys, "cohort_month").agg(
        F.count_distinct(customer).alias("customers"), F.sum("orders").alias("orders"), F.sum("amount_minor").cast("bigint").alias("amount_minor")
    )


def retention(members: DataFrame, keys: list[str], customer: str) -> DataFrame:
    """Per cohort: repeat and returning customers in basis points, average orders times 100."""
    each = members.groupBy(*keys, "cohort_month", customer).agg(F.sum("orders").alias("n"), F.max("period_index").alias("last"))
    out = each.groupBy(*keys, "cohort_month").agg(
        F.count("*").alias("customers"), F.count_if(F.col("n") >= 2).alias("repeaters"), F.count_if(F.col("last") >= 1).alias("returning"), F.sum("n").alias("orders")
    )
    c = F.col("customers")
    return out.withColumn("repeat_bps", bps(F.col("repeaters"), c)).withColumn("returning_bps", bps(F.col("returning"), c)).withColumn(
        "avg_orders_x100", F.expr("orders * 100 div customers")
    )


def histogram(rows: DataFrame, keys: list[str], value: str, bounds: list[tuple[str, int | None]]) -> DataFrame:
    """Counts of a value by bucket (label, upper bound inside), with a row for empty buckets too.

    The buckets are a constant of the call and go along as an array, so the fill needs no join.
    """
    v = F.col(value)
    label = ladder([(v <= upper, name) for name, upper in bounds if upper is not None], bounds[-1][0])
    counted = rows.where(v.isNotNull()).groupBy(*keys, label.alias("bucket")).agg(F.count("*").alias("n"))
    packed = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("_m"))
    names = F.array(*[F.struct(F.lit(i).alias("bucket_order"), F.lit(name).alias("bucket")) for i, (name, _) in enumerate(bounds)])
    out = packed.select(*keys, "_m", F.inline(names))
    return out.select(*keys, "bucket_order", "bucket", F.coalesce(F.try_element_at("_m", F.col("bucket")), F.lit(0)).cast("bigint").alias("n"))


def nth_gap_days(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Days from the first to the second row of each key, without sorting whole groups: the two smallest."""
    two = F.slice(F.array_sort(F.collect_list(F.struct(at, tie))), 1, 2)
    w = Window.partitionBy(*keys).orderBy(at, tie)
    firsts = rows.select(*keys, at, tie).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2)
    out = firsts.groupBy(*keys).agg(two.alias("_t")).where(F.size("_t") == 2)
    return out.select(*keys, F.date_diff(F.col("_t")[1][at], F.col("_t")[0][at]).alias("days"))


def stage_counts(events: DataFrame, keys: list[str], unit: Column, stages: dict[str, Column]) -> DataFrame:
    """Distinct units that meet each stage's condition, by keys."""
    marks = events.groupBy(*keys, unit.alias("_u")).agg(*[F.bool_or(c).alias(s) for s, c in stages.items()])
    return marks.groupBy(*keys).agg(*[F.count_if(F.col(s)).alias(s) for s in stages])


def furthest_stage(events: DataFrame, keys: list[str], stages: dict[str, Column]) -> DataFrame:
    """Per key which stages were reached, and the last of them in the order given."""
    out = events.groupBy(*keys).agg(*[F.bool_or(c).alias(s) for s, c in stages.items()])
    return out.withColumn("furthest", ladder([(F.col(s), s) for s in reversed(stages)], "none"))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def mode(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Most frequent value of each key, ties to the smaller value; nulls and empty strings don't count.

    Two aggregates that combine before their shuffles, so a hot key is only its values' counts.
    """
    n = rows.where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(name))


def affinity(lines: DataFrame, keys: list[str], basket: str, item: str, top: int = 50) -> DataFrame:
    """Pairs a < b of items in one basket: baskets together, of each, support in percent; the ``top`` of each a.

    A basket's pairs are made from its sorted distinct items, in place of a self-join.
    """
    baskets = lines.groupBy(*keys, basket).agg(F.array_sort(F.collect_set(item)).alias("_i"))
    total = baskets.groupBy(*keys).agg(F.count("*").alias("baskets"))
    single = baskets.select(*keys, F.explode("_i").alias("item")).groupBy(*keys, "item").agg(F.count("*").alias("n"))
    pairs = baskets.select(*keys, F.posexplode("_i").alias("_p", "item_a"), "_i").select(
        *keys, "item_a", F.explode(F.expr("slice(_i, _p + 2, size(_i))")).alias("item_b")
    )
    pairs = pairs.groupBy(*keys, "item_a", "item_b").agg(F.count("*").alias("together"))
    of = lambda x: single.select(*keys, F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}"))
    out = pairs.join(of("a"), [*keys, "item_a"]).join(of("b"), [*keys, "item_b"]).join(total, keys)
    out = out.withColumn("support_pct", F.round(F.col("together") * 100.0 / F.col("baskets"), 4))
    return top_n(out, [*keys, "item_a"], [F.desc("together"), F.asc("item_b")], top)
