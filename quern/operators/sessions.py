"""Gap sessions, touch numbering, session and visitor roll-ups, and journey paths.

All windows of a visitor share one exchange on the visitor's key, ordered by time, then event id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessionize(events: DataFrame, keys: list[str], at: str, tie: str, gap_s: int = 1800) -> DataFrame:
    """Add session_seq (from 1), touch_seq, is_first_touch and is_last_touch.

    A new session starts where the gap is greater than ``gap_s`` whole seconds.
    """
    w = Window.partitionBy(*keys).orderBy(at, tie)
    gap = F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(F.lag(at).over(w).cast("timestamp"))
    starts = F.coalesce((gap > gap_s).cast("int"), F.lit(0))
    return (
        events.withColumn("_s", starts)
        .withColumn("session_seq", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)
        .withColumn("touch_seq", F.row_number().over(w))
        .withColumn("is_first_touch", F.col("touch_seq") == 1)
        .withColumn("is_last_touch", F.lead(F.lit(True)).over(w).isNull())
        .drop("_s")
    )


def repeats_within(events: DataFrame, keys: list[str], at: str, tie: str, seconds: int = 60) -> DataFrame:
    """Add is_composite: whether an earlier row of the same keys lies at most ``seconds`` back."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    gap = F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(F.lag(at).over(w).cast("timestamp"))
    return events.withColumn("is_composite", F.coalesce(gap <= seconds, F.lit(False)))


def near_in_time(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, seconds: int = 60) -> DataFrame:
    """Left rows with every right row of their keys within ``seconds`` (a left join).

    Time buckets make the range an equi-join: a right row stands in its own bucket and both
    neighbours, so a hot key is dealt by time too.
    """
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    r = right.withColumn("_b", F.explode(F.array(*[bucket(right_at) + i for i in (-1, 0, 1)])))
    l_ = left.withColumn("_b", bucket(left_at))
    gap = F.abs(F.unix_micros(F.col(left_at).cast("timestamp")) - F.unix_micros(F.col(right_at).cast("timestamp")))
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "_b"]]
    condition = on[0]
    for c in [*on[1:], gap <= seconds * 1_000_000]:
        condition = condition & c
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return l_.alias("l").join(r.alias("r"), condition, "left").select("l.*", *extra).drop("_b")


def rollup_sessions(touches: DataFrame, keys: list[str], at: str, values: dict[str, str], converted: Column) -> DataFrame:
    """Per session: touches, start, end, seconds, first and last of each value, bounce, converted."""
    ends: list[Column] = []
    for name, column in values.items():
        ends += [F.min_by(column, "touch_seq").alias(f"first_{name}"), F.max_by(column, "touch_seq").alias(f"last_{name}")]
    out = touches.groupBy(*keys, "session_seq").agg(
        F.count("*").alias("touches"), F.min(at).alias("started_at"), F.max(at).alias("ended_at"), *ends, F.bool_or(converted).alias("converted")
    )
    seconds = F.unix_seconds(F.col("ended_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    return out.withColumn("duration_s", seconds).withColumn("bounced", F.col("touches") == 1)


def ordered(column: str, order: str) -> Column:
    """A group's values in order, as an aggregate; ``order`` must be unique in the group."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column])


def collapse(path: Column) -> Column:
    """A path without repeats of the step just before."""
    zero = F.array().cast("array<string>")
    return F.aggregate(path, zero, lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == x), acc).otherwise(F.array_append(acc, x)))


def edges(path: Column) -> Column:
    """(step, from, to) of every move along a path; a path of one step has none."""
    moves = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(path) - 1, F.lit(1))),
        lambda i: F.struct(i.cast("bigint").alias("step"), F.get(path, i - 1).alias("from_channel"), F.get(path, i).alias("to_channel")),
    )
    return F.filter(moves, lambda m: m["to_channel"].isNotNull())
