"""Upkeep of raw logs and tables: dedup, retention, erasure, compaction, and the order of jobs."""

from __future__ import annotations

from collections.abc import Callable
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quern.operators.tables import StoredTable
from quern.operators.upsert import best_by
from quern.session import stored


def dedup_log(log: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """The latest row of each key by arrival (time, offset, partition); rows without a key all stay."""
    values = [c for c in log.columns if c not in keys]
    known = log
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    kept = best_by(known, keys, F.struct(*arrival), values).select(*log.columns)
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    return kept.unionByName(log.where(some_null))


def retain(log: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    """Rows not older than ``days``; those without a time stay."""
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return log.where(F.col(at).isNull() | (F.col(at) >= limit))


def erase(log: DataFrame, subjects: DataFrame, column: str) -> DataFrame:
    """The log without the rows of erased subjects (hashes); an anti-join on their distinct values."""
    gone = subjects.select(F.col(column).alias("_gone")).where(F.col("_gone").isNotNull()).distinct()
    return log.join(gone, F.col(column) == F.col("_gone"), "left_anti")


def _schema(paths: list[str]) -> StructType:
    """The structure that holds dotted paths, all strings."""
    tree: dict = {}
    for path in paths:
        at = tree
        for name in path.split("."):
            at = at.setdefault(name, {})
    made = lambda t: StructType([StructField(n, made(x) if x else StringType()) for n, x in t.items()])
    return made(tree)


def payload_hits(log: DataFrame, subjects: DataFrame, keys: list[str], brand: str, paths: dict[str, list[str]], payload: str = "payload") -> DataFrame:
    """Keys of the log rows whose payload names a subject (brand_id, kind, value) at any path of its kind, in that tenant.

    A payload is parsed once for all paths; one that can't be parsed names nobody.
    """
    every = [p for own in paths.values() for p in own]
    parsed = log.select(*keys, F.inline(F.array(F.from_json(payload, _schema([brand, *every])))))
    told = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(p).alias("value")) for kind, own in paths.items() for p in own])
    named = parsed.select(*keys, F.col(brand).alias("brand_id"), F.inline(told)).where(F.col("value").isNotNull())
    return named.join(subjects.select("brand_id", "kind", "value").distinct(), ["brand_id", "kind", "value"], "left_semi").select(*keys).distinct()


def erase_payloads(table: StoredTable, subjects: DataFrame, brand: str, paths: dict[str, list[str]], payload: str = "payload") -> int:
    """Drop those rows from a stored log; buckets without any stay as they are. Returns how many were dropped; a rerun drops none."""
    log = table.read()
    hits = stored(payload_hits(log, subjects, table.keys, brand, paths, payload))
    n = hits.count()
    if n:
        table.swap(log.limit(0), hits)
    return n


def compact(spark: SparkSession, path: str, target: str, partition_by: list[str], rows_per_file: int = 1_000_000) -> None:
    """Rewrite a table's files, partition by partition, into files of at most ``rows_per_file`` rows.

    Rebalancing splits large partitions and joins small ones, so no task gets a whole hot partition.
    """
    rows = spark.read.parquet(path).hint("rebalance", *partition_by)
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)


Job = Callable[[], int]


def run_tiers(jobs: dict[str, tuple[set[str], Job]]) -> dict[str, int | str]:
    """Run jobs after those that they need: rows written by each, ``failed: ...``, or ``skipped`` after a failure."""
    done: dict[str, int | str] = {}
    for name in TopologicalSorter({n: needs for n, (needs, _) in jobs.items()}).static_order():
        needs, job = jobs[name]
        if any(not isinstance(done[n], int) for n in needs):
            done[name] = "skipped"
            continue
        try:
            done[name] = job()
        except Exception as problem:  # a job's failure is a result of the run; others go on
            done[name] = f"failed: {problem}"
    return done
