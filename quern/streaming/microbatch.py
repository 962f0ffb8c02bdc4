"""Structured Streaming: admission, upserts of micro-batches, event-time windows and sessions with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.upsert import latest, merge_on_key


def read_folder(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once_per_event(stream: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Each event once, with state that the watermark bounds."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, keys: list[str], at: str, amount: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by keys and tumbling window; late rows within the watermark count."""
    w = F.window(at, width)
    rows = stream.withWatermark(at, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(amount).alias("amount"))
    return rows.select(F.col("window.start").alias("window_start"), *keys, "n", "amount")


def sessions(stream: DataFrame, keys: list[str], at: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Closed gap sessions with their touches."""
    w = F.session_window(at, gap)
    rows = stream.withWatermark(at, late).groupBy(w, *keys).agg(F.count("*").alias("touches"))
    return rows.select(F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("closes_at"), *keys, "touches")


class Versions:
    """A table as numbered folders of Parquet, the newest complete one being current.

    A batch writes the folder of its own number from the one before, so a replayed batch gives the
    same rows: it overwrites what it had begun.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _numbers(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName()[1:]) for p in names if p.getName().startswith("v") and fs.exists(path(p, "_SUCCESS")))

    def current(self, before: int | None = None) -> DataFrame:
        have = [n for n in self._numbers() if before is None or n < before]
        if not have:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v{have[-1]}")

    def write(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/v{number}")


def upsert_stream(stream: DataFrame, table: Versions, keys: list[str], order: list[Column], checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Merge every micro-batch into the table by key; runs over what is there, then stops."""

    def put(batch: DataFrame, number: int) -> None:
        rows = transform(batch) if transform else batch
        table.write(merge_on_key(table.current(before=number), latest(rows, keys, order), keys, order), number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
