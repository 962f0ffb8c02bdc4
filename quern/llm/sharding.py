"""Sharding by Hilbert-curve order: quantise metadata, sort by curve index, cut equal runs.

Each dimension is quantised to bins of equal depth, so that the curve's cells hold like numbers of
rows; a string dimension with no more values than bins has a bin a value. Equal texts take the
smallest curve index among them, so they stand together even where their metadata differ. Texts
never move to be ranked: rows of ids, sizes and bins are ranked globally by range partitioning.
The order is by curve index, CRC-32 and hash of the text, doc_id.

Defined results: a null text has no bytes and a null CRC-32, and null texts are a group of equal texts;
texts are measured whole; null metadata falls into the lowest bin; ties in all of the order are rows that
are equal in all that is looked at, and rows that repeat are rows of their own; an empty table gives an
empty table; other columns of the input are ignored by ``digest`` and carried by ``sharded``, which puts
underscores behind the name of a column it adds where the input has that name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quern.llm.common import cut, fresh, global_rank, lookup, python_workers

DIMENSIONS = ("source", "lang", "n_chars")


def hilbert_index(bins: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of ``bins`` (rows by dimensions, values under 2**bits)."""
    x = bins.astype(np.int64).T.copy()
    n = len(x)
    step = 1 << (bits - 1)
    while step > 1:  # undo the excess reflections, from the highest bit down
        low = step - 1
        for i in range(n):
            on = (x[i] & step) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        step >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    step = 1 << (bits - 1)
    while step > 1:
        flip = np.where(x[n - 1] & step, flip ^ (step - 1), flip)
        step >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _string_edges(rows: DataFrame, name: str, bins: int) -> list[str]:
    """The largest values of all bins but the last: every value where there are no more than bins, else at equal depths."""
    counts = cut(rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n")))
    few = [r["v"] for r in counts.select("v").limit(bins + 1).collect()]
    if len(few) <= bins:
        return sorted(few, key=lambda v: v.encode("utf-8", "surrogatepass"))[:-1]
    total = counts.agg(F.sum("n")).first()[0]
    at = global_rank(counts, [F.col("v")], "before", "n")
    cell = lambda upto: F.floor(upto * F.lit(bins) / F.lit(total))
    edges = at.where((cell(F.col("before") + F.col("n")) > cell(F.col("before"))) & (F.col("before") + F.col("n") < total))
    return [r["v"] for r in edges.orderBy("v").select("v").collect()]  # under ``bins`` rows: each passes a mark


def _bins(rows: DataFrame, names: list[str], bins: int) -> list[Column]:
    """The bin of each dimension: the number of its edges that lie below the value."""
    kinds = {n: isinstance(rows.schema[n].dataType, NumericType) for n in names}
    numbers = [n for n in names if kinds[n]]
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(n, at, 10_000).alias(n) for n in numbers]).first() if numbers else {}
    out = []
    for n in names:
        edges = sorted(set(found[n] or [])) if kinds[n] else _string_edges(rows, n, bins)
        below = F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<string>")
        out.append(_below(below, F.col(n)) if edges else F.lit(0))
    return out


def _below(edges: Column, value: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e < value))


def _curve(bins: list[Column], bits: int) -> Column:
    @F.pandas_udf("bigint")
    def curve(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy(np.int64) for c in columns], axis=1), bits))

    return curve(*bins)


def _measured(docs: DataFrame, dimensions: tuple[str, ...]) -> list[Column]:
    """Id, size, CRC-32 and hash of the text, and the dimensions as numbers or strings."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint")
    kind = {d: "double" if isinstance(docs.schema[d].dataType, NumericType) else "string" for d in dimensions}
    values = [F.col(f"`{d}`").cast(kind[d]).alias(f"d{i}") for i, d in enumerate(dimensions)]
    return [F.col("doc_id"), size.alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), F.xxhash64("text").alias("text_hash"), *values]


KEYS = ("curve", "text_crc32", "text_hash", "doc_id", "size")


def _ranked(docs: DataFrame, dimensions: tuple[str, ...], bits: int):
    """(rows of ids and sizes with their rank in the order, their number, the curve, the groups whose metadata differ)."""
    python_workers(docs.sparkSession)
    rows = cut(docs.select(*_measured(docs, dimensions)))
    curve = _curve(_bins(rows, [f"d{i}" for i in range(len(dimensions))], 1 << bits), bits)
    rows = cut(rows.select("doc_id", "size", "text_crc32", "text_hash", curve.alias("curve")))
    least = rows.groupBy("text_hash").agg(F.min("curve").alias("lead"), F.max("curve").alias("_most"))
    leads = cut(least.where(F.col("lead") < F.col("_most")).drop("_most"))
    rows = _led(rows, leads)
    return global_rank(rows, [F.col(k) for k in KEYS]), rows.count(), curve, leads


def _led(rows: DataFrame, leads: DataFrame) -> DataFrame:
    """``rows`` with the curve index of their group of equal texts."""
    return lookup(rows, leads, ["text_hash"]).withColumn("curve", F.coalesce("lead", "curve")).drop("lead")


def digest(docs: DataFrame, shards: int = 24, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = 6) -> DataFrame:
    """Shards under the law ``rows``: runs of the order whose counts are at most one apart.

    A group of equal texts is in one shard, or in neighbouring ones where a cut falls into it.
    """
    ranked, n, _, _ = _ranked(docs, dimensions, bits)
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("shard", F.expr(f"rank * {shards}L div {max(n, 1)}L")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def sharded(docs: DataFrame, shards: int = 24, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = 6) -> DataFrame:
    """``docs`` with ``curve`` and ``shard``, dealt and sorted in curve order, as files to be pruned.

    A row's shard is the number of shards whose first row stands at or before it, so texts move
    once, when they are dealt by range. Rows that repeat both doc_id and text stay together.
    """
    ranked, n, curve, leads = _ranked(docs, dimensions, bits)
    starts = sorted({-(-s * n // shards) for s in range(1, shards)} - {n})
    heads = ranked.where(F.col("rank").isin(starts)).orderBy("rank").select("rank", *KEYS).collect() if starts else []
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("_row"), *_measured(docs, dimensions))
    rows = _led(rows.withColumn("curve", curve).drop(*[f"d{i}" for i in range(len(dimensions))]), leads)
    key = F.struct(*[F.col(k) for k in KEYS])
    schema = rows.select(key.alias("k")).schema["k"].dataType.simpleString()
    before = F.lit(0)
    for head in heads:  # shards - 1 rows at most; empty shards begin where the next one does
        at = F.struct(*[F.lit(head[k]) for k in KEYS]).cast(schema.replace("`", ""))
        step = sum(1 for s in range(1, shards) if -(-s * n // shards) == head["rank"])
        before = before + F.when(key >= at, F.lit(step)).otherwise(F.lit(0))
    order = [F.col("shard"), *[F.col(k) for k in KEYS[:4]]]
    dealt = rows.withColumn("shard", before.cast("int")).repartitionByRange(*order).sortWithinPartitions(*order)
    names = [fresh("curve", docs.columns), fresh("shard", docs.columns)]
    return dealt.select("_row.*", F.col("curve").alias(names[0]), F.col("shard").alias(names[1]))
