"""What the corpus operators share: lineage cuts, size-checked joins, global ranks and the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import shelf, ship, stored, table

Query = Callable[[SparkSession, str], DataFrame]

cut = stored

#: Rows of a lookup side up to which a join may broadcast it; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 50_000


def lookup(df: DataFrame, side: DataFrame, on: list[str] | Column, how: str = "left", limit: int = BROADCAST_ROWS, most: int | None = None) -> DataFrame:
    """Join ``df`` with a lookup side that is broadcast only if it has ``limit`` rows at most.

    Its rows are counted, unless ``most`` tells a bound that is known. ``side`` should be cut (or
    cheap), since the count is an action of its own.
    """
    few = (side.limit(limit + 1).count() if most is None else most) <= limit
    return df.join(F.broadcast(side) if few else side, on, how)


def global_rank(df: DataFrame, keys: list[Column], rank: str = "rank", weight: str | None = None) -> DataFrame:
    """Add the 0-based rank of each row in the order of ``keys`` without a one-task sort.

    Rows are dealt by range and sorted within partitions; a row's rank is its place in its
    partition plus the rows of the partitions before it. With ``weight``, the rank is the sum of that
    column over the rows before. ``df`` should be cut, and ``keys`` should tell rows apart, so that
    a recomputed task gives the same order.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ordered = cut(ordered.withColumn("_p", F.shiftright("_at", 33)))
    sums = ordered.groupBy("_p").agg(F.count("*") if weight is None else F.sum(weight).cast("bigint")).toDF("_p", "_n")
    by_part = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = F.broadcast(sums.select("_p", F.coalesce(F.sum("_n").over(by_part), F.lit(0)).alias("_before")))
    if weight is None:
        place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    else:
        in_part = Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        place = F.coalesce(F.sum(weight).over(in_part), F.lit(0))
    return ordered.withColumn(rank, place).join(before, "_p").withColumn(rank, F.col(rank) + F.col("_before")).drop("_at", "_p", "_before")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it where columns of that name (in any case) are there already."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def unit(key: Column) -> Column:
    """A number in [0, 1) from a 64-bit hash."""
    return F.shiftrightunsigned(key, 11).cast("double") / F.lit(float(1 << 53))


def python_workers(spark: SparkSession, size: str = "2m") -> None:
    """Make the package known to Python workers and let Arrow batches hold ``size`` of rows at most.

    Long texts then don't add up in a worker.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
