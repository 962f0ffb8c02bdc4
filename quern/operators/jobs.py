"""Incremental jobs: a stored watermark, and one run that pins, reads, merges and only then advances it."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.tables import StoredTable
from quern.operators.upsert import in_window, incremental_window
from quern.session import stored
from quern.sources.events import or_empty

MARKS = "job string, watermark timestamp, at bigint"


def read_watermark(spark: SparkSession, marks: str, job: str) -> datetime | None:
    """The latest mark that a job has written, or None before its first run."""
    rows = or_empty(spark, marks, MARKS).where(F.col("job") == job)
    return rows.agg(F.max_by("watermark", "at")).first()[0]


def write_watermark(spark: SparkSession, marks: str, job: str, watermark: datetime) -> None:
    """Append a mark; earlier ones stay, so a run that is lost halfway changes nothing."""
    number = or_empty(spark, marks, MARKS).where(F.col("job") == job).agg(F.coalesce(F.max("at"), F.lit(0))).first()[0]
    spark.createDataFrame([(job, watermark, number + 1)], MARKS).write.mode("append").parquet(marks)


def run_job(
    spark: SparkSession, job: str, source: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, marks: str, keys: list[str], order: list[Column], *, column: str = "ingested_at", full: bool = False,
) -> dict:
    """One run: pin the newest source time, build the window's rows, merge them into ``target``, then advance the mark.

    The target is a ``StoredTable``: only buckets that staged keys touch are read and written, and its pointer moves after
    them, so a run that dies while writing leaves the old table. The mark moves last: a run that fails is repeated over the same
    window, and the merge makes that harmless. Prints a line of JSON.
    """
    high = source.agg(F.max(column)).first()[0]
    window = incremental_window(read_watermark(spark, marks, job), high, full=full)
    table = StoredTable(spark, target, keys)
    table.merge(stored(build(in_window(source, column, window))), keys, order)
    if high is not None:
        write_watermark(spark, marks, job, high)
    line = {"job": job, "from": str(window[0]), "to": str(high), "rows": table.read().count()}
    print(json.dumps(line), flush=True)
    return line
