"""Tables kept as Parquet without a table format: hash buckets of a key, numbered versions, and a pointer that is moved last.

A write puts the buckets that it touches into a folder of its own and then names, in one small file that is
renamed into place, the folder of every bucket. Readers follow the newest pointer, so a write that dies halfway changes
nothing: its folder has no pointer, and the next write takes its number again. Buckets that a write doesn't touch stay as they are. One
writer at a time; old folders stay until someone drops them. Facts (a watermark, say) move with the pointer.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.upsert import latest

BUCKETS = 64
_BUCKET = "_bucket"


class StoredTable:
    """A bucketed table under ``root``, which all executors share. ``keys`` decide the bucket and never change."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> str:
        return f"{self.root}/pointers"

    def pointer(self) -> dict | None:
        """The newest pointer: number, schema, folders by bucket, facts."""
        top = self._path(self._pointers())
        if not self._fs.exists(top):
            return None
        numbers = [int(s.getPath().getName()) for s in self._fs.listStatus(top) if s.getPath().getName().isdigit()]
        if not numbers:
            return None
        stream = self._fs.open(self._path(f"{self._pointers()}/{max(numbers)}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def facts(self) -> dict:
        return (self.pointer() or {"facts": {}})["facts"]

    def read(self, schema: StructType | None = None, only: Iterable[int] | None = None) -> DataFrame:
        """The table, or those of its buckets; empty, of ``schema``, before its first write."""
        now = self.pointer()
        if now is None:
            return self.spark.createDataFrame([], schema)
        kept = set(now["folders"]) if only is None else {str(b) for b in only} & set(now["folders"])
        told = StructType.fromJson(now["schema"])
        paths = [f"{now['folders'][b]}/{_BUCKET}={b}" for b in sorted(kept, key=int)]
        return self.spark.read.schema(told).parquet(*paths) if paths else self.spark.createDataFrame([], told)

    def _marked(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _put(self, rows: DataFrame, folders: dict, touched: set[int], facts: dict, was: dict | None) -> None:
        number = (was["number"] if was else 0) + 1
        folder = f"{self.root}/data/{number}"
        self._marked(rows).repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(folder)
        there = {s.getPath().getName().removeprefix(f"{_BUCKET}=") for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith(_BUCKET)}
        kept = {b: f for b, f in folders.items() if int(b) not in touched} | {b: folder for b in there}
        told = {"number": number, "schema": json.loads(rows.schema.json()), "folders": kept, "facts": (was["facts"] if was else {}) | facts}
        self._point(number, told)

    def _point(self, number: int, told: dict) -> None:
        """The new pointer, written beside its place and renamed into it."""
        draft, place = self._path(f"{self._pointers()}/.draft-{number}"), self._path(f"{self._pointers()}/{number}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if not self._fs.rename(draft, place):
            raise RuntimeError(f"version {number} of {self.root} was written by another")

    def replace(self, rows: DataFrame, **facts: str) -> None:
        """All of the table anew."""
        was = self.pointer()
        self._put(rows, {}, set(range(self.buckets)), facts, was)

    def swap(self, rows: DataFrame, groups: DataFrame, **facts: str) -> None:
        """``rows`` in place of all rows of ``groups`` (columns that hold the keys): only their buckets are read and written."""
        was = self.pointer()
        if was is None:
            return self.replace(rows, **facts)
        touched = {r[0] for r in self._marked(groups.select(*self.keys)).select(_BUCKET).distinct().collect()}  # the buckets' number at most
        if not touched:
            return self._put(rows.limit(0), was["folders"], set(), facts, was) if facts else None
        kept = self.read(only=touched).join(groups.distinct(), groups.columns, "left_anti")
        return self._put(kept.unionByName(rows, allowMissingColumns=True), was["folders"], touched, facts, was)

    def merge(self, staged: DataFrame, keys: list[str], order: list[Column], **facts: str) -> None:
        """Upsert: the first staged row of each key in ``order`` replaces the one there. ``keys`` hold the table's keys."""
        self.swap(latest(staged, keys, order), staged.select(*keys), **facts)
