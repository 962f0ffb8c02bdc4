"""Incremental tables without a table format: dedup, merge, orphans, windows, parity, versions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import stored


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; ``order`` must end in something unique."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def best_by(df: DataFrame, keys: list[str], rank: Column, columns: list[str]) -> DataFrame:
    """The row of each key with the greatest ``rank`` by one aggregate, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), rank).alias("_b")).select(*keys, "_b.*")


def evolve(df: DataFrame, old: DataFrame) -> DataFrame:
    """``df`` with the stored table's columns (null where new rows lack them) and any columns of its own."""
    return old.limit(0).unionByName(df, allowMissingColumns=True)


def merge_on_key(old: DataFrame, staged: DataFrame, keys: list[str], order: list[Column], shed: bool = False) -> DataFrame:
    """The table after an upsert: staged rows win over old ones of their key.

    With ``shed`` the staged rows are a full fold and old keys that it lacks are dropped, unless it
    is empty. One shuffle on the key: old and staged rows are tagged and the first is taken.
    """
    fresh = latest(staged, keys, order)
    both = old.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    kept = both.withColumn("_has", F.max("_new").over(w)).where(F.col("_new") == F.col("_has")).drop("_has")
    if shed and staged.limit(1).count():
        kept = kept.where(F.col("_new") == 1)
    return kept.drop("_new")


def incremental_window(
    watermark: datetime | None, batch_max: datetime | None, *, lookback_s: int = 600, slice_s: int | None = None, full: bool = False
) -> tuple[datetime | None, datetime | None]:
    """(low, high) of the rows to read, both ends inside; (None, None) means all rows.

    ``high`` is pinned before the read. A first run, or a full one, has no window. A slice bounds
    how far a run that has fallen behind goes at once.
    """
    if full or watermark is None or batch_max is None:
        return None, None
    high = batch_max if slice_s is None else min(batch_max, watermark + timedelta(seconds=slice_s))
    return watermark - timedelta(seconds=lookback_s), max(high, watermark)


def in_window(df: DataFrame, column: str, window: tuple[datetime | None, datetime | None]) -> DataFrame:
    low, high = window
    if low is not None:
        df = df.where(F.col(column) >= F.lit(low))
    return df if high is None else df.where(F.col(column) <= F.lit(high))


def refold_changed(events: DataFrame, keys: list[str], column: str, window: tuple[datetime | None, datetime | None]) -> DataFrame:
    """The whole history of every entity that has a row in the window."""
    if window[0] is None:
        return events
    changed = in_window(events, column, window).select(*keys).distinct()
    return events.join(changed, keys, "left_semi")


def parity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row of figures on two tables of a key: rows only on either side, rows that differ, equal rows."""
    values = [c for c in left.columns if c not in keys]
    tag = lambda df, n: df.select(*keys, F.struct(*values).alias(n))
    both = tag(left, "_l").join(tag(right, "_r"), keys, "full_outer")
    in_l, in_r = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    same = F.col("_l").eqNullSafe(F.col("_r"))
    return both.agg(
        F.count_if(in_l & ~in_r).alias("only_left"),
        F.count_if(in_r & ~in_l).alias("only_right"),
        F.count_if(in_l & in_r & ~same).alias("different"),
        F.count_if(in_l & in_r & same).alias("equal"),
    )


def ranked(df: DataFrame, keys: list[str], rank: str = "_rank") -> DataFrame:
    """Rows with their 0-based place in the order of ``keys``, which tell rows apart: dealt by range and sorted in their part, not in one task."""
    part = F.shiftright("_at", 33)
    at = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = at.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn(rank, place).drop("_p", "_at", "_start")


def ordered_digest(df: DataFrame, keys: list[str], columns: list[str], fan: int = 4096) -> str | None:
    """MD5 of the rows in the order of ``keys``: of their texts (columns joined by |, a row a line) for up to ``fan`` rows.

    Beyond, it is a tree: the digests of runs of ``fan`` rows are digested in turn, so no task sees more than ``fan``
    of them. Equal digests mean equal rows in an equal order. None for an empty table. Null values leave their place out, as ``concat_ws`` does.
    """
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    level = ranked(df.select(*keys, line.alias("_text")), keys).select("_rank", "_text")
    while True:
        run = F.floor(F.col("_rank") / fan).cast("bigint")
        texts = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_text"))), lambda x: x["_text"])
        level = stored(level.groupBy(run.alias("_run")).agg(F.md5(F.array_join(texts, "\n")).alias("_text")).withColumnRenamed("_run", "_rank"))
        found = level.limit(2).collect()
        if len(found) < 2:
            return found[0]["_text"] if found else None


def ordered_parity(left: DataFrame, right: DataFrame, keys: list[str], fan: int = 4096) -> DataFrame:
    """``parity``, and each side's ordered digest over the keys that both have."""
    columns = [*keys, *[c for c in left.columns if c not in keys]]
    shared = lambda a, b: ordered_digest(a.join(b.select(*keys), keys, "left_semi"), keys, columns, fan)
    a, b = shared(left, right), shared(right, left)
    return parity(left, right, keys).select("*", F.lit(a).cast("string").alias("left_digest"), F.lit(b).cast("string").alias("right_digest"), F.lit(a == b).alias("same_order"))


def snapshot(history: DataFrame, today: DataFrame, date: str, column: str = "snapshot_date") -> DataFrame:
    """History with today's state appended under its date; a rerun replaces the date's rows."""
    kept = history.where(F.col(column) != F.lit(date).cast("date"))
    return kept.unionByName(today.withColumn(column, F.lit(date).cast("date")), allowMissingColumns=True)


def version_history(states: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Half-open validity bands of an entity's values from dated states; equal neighbours make one band."""
    w = Window.partitionBy(*keys).orderBy(at)
    packed = F.struct(*values)
    changed = ~F.coalesce(F.lag(packed).over(w).eqNullSafe(packed), F.lit(False)) | (F.row_number().over(w) == 1)
    starts = states.withColumn("_c", changed).where("_c").drop("_c")
    return starts.withColumn("valid_to", F.lead(at).over(w)).withColumnRenamed(at, "valid_from")


def bitemporal_merge(old: DataFrame, staged: DataFrame, keys: list[str], values: list[str], now: str) -> DataFrame:
    """Append-only system time: changed open rows are closed at ``now``, new versions opened, the rest kept.

    ``old`` has keys, values, system_from and system_to (null while open). Replaying the same staged rows
    changes nothing.
    """
    at = F.lit(now).cast("timestamp")
    opened = old.where(F.col("system_to").isNull())
    fresh = staged.select(*keys, F.struct(*values).alias("_new"))
    both = opened.join(fresh, keys, "full_outer")
    was = F.struct(*values)
    there = F.col("system_from").isNotNull()
    same = there & (F.col("_new").isNull() | was.eqNullSafe(F.col("_new")))
    kept = both.where(there).withColumn("system_to", F.when(~same, at)).select(*keys, *values, "system_from", "system_to")
    added = both.where(F.col("_new").isNotNull() & ~same).select(*keys, "_new.*", at.alias("system_from"), F.lit(None).cast("timestamp").alias("system_to"))
    closed = old.where(F.col("system_to").isNotNull()).select(*keys, *values, "system_from", "system_to")
    return closed.unionByName(kept).unionByName(added)


def as_of(history: DataFrame, at: Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows of half-open bands that hold ``at``."""
    return history.where((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at)))
