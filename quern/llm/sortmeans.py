"""Centroid clustering by sort-means: nearest centroids found in order of their distance from the last one.

Vectors of a fixed length are quantised to integers, so that sums, means and distances are exact and
don't depend on how rows are dealt. In a round every centroid has the others in ascending order of
their distance from it. A vector starts at the centroid that it had in the round before and scans that
order; by the triangle inequality no centroid strictly beyond twice the vector's distance from its
start can be nearer, so the scan stops there (a centroid at exactly twice can be as near, and ties
go to the smaller number). The rows of a batch that start at one centroid scan together, and each
step keeps those that still go on.

A round is one pass over the table: a task replays the vectors' earlier rounds (whose centroids are
``k`` vectors each), so nothing of the table's size is written between rounds, and a lost
executor's part is made again from the table alone. Replayed rounds start near their ends, so they
scan little; the work is of the order of rounds squared in the worst case, which suits a few rounds. A
task sends one row of sums a centroid; only ``k`` centroids come to the driver. The final
assignment, three numbers a vector, is cut once for its totals.

Defined results: vectors that are null, of another length or hold null or non-finite components take no
part; a component beyond 2**27 after scaling is an error that says so, since squared distances would not fit into
64 bits; a row without vec_id takes part but starts no centroid; of rows that repeat a vec_id those with smaller components
start centroids first; where fewer vectors than ``k`` can start one there are fewer centroids, and where none can,
cluster and totals are null; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, lookup, python_workers

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
LARGEST = 1 << 27


def quantised(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the rows that take part, components as floor(scale * x)."""
    x = F.col("embedding")
    good = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    small = lambda v: F.when(F.abs(v) <= LARGEST, v).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("double"))
    whole = F.transform(x, lambda c: F.floor(small(c.cast("double") * scale)).cast("bigint"))
    return embeddings.where(x.isNotNull() & good).select("vec_id", whole.alias("v"))


def nearest(x: np.ndarray, centroids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance) of each row by a scan from its start, and how many distances were taken."""
    between = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    reach = (between + 3) // 4  # a centroid is strictly beyond twice a distance d where d * d < reach
    best, distance = start.copy(), ((x - centroids[start]) ** 2).sum(1)
    taken = len(x)
    for p in range(len(centroids)):
        rows = np.flatnonzero(start == p)
        own = distance[rows]
        for j in np.argsort(between[p], kind="stable"):
            if j == p:
                continue
            on = own >= reach[p, j]
            rows, own = rows[on], own[on]
            if not len(rows):
                break
            there = ((x[rows] - centroids[j]) ** 2).sum(1)
            taken += len(rows)
            better = (there < distance[rows]) | ((there == distance[rows]) & (j < best[rows]))
            best[rows[better]], distance[rows[better]] = j, there[better]
    return best, distance, taken


def _replayed(batch: pa.RecordBatch, generations: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, their centroids in the last generation, squared distances)."""
    v = batch.column("v")
    x = v.flatten().to_numpy().reshape(len(v), -1) if len(v) else np.zeros((0, generations[0].shape[1]), np.int64)
    at = np.zeros(len(x), np.int64)
    for centroids in generations:
        at, distance, _ = nearest(x, centroids, at)
    return x, at, distance


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose hash of seed and vec_id is smallest, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where(F.col("vec_id").isNotNull()).select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def moved(vectors: DataFrame, generations: list[np.ndarray]) -> np.ndarray:
    """The next centroids: exact floors of the means of their vectors, those without vectors as they were."""
    last = generations[-1]
    width = last.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(last), np.int64), np.zeros(last.shape, np.int64)
        for batch in batches:
            x, at, _ = _replayed(batch, generations)
            n += np.bincount(at, minlength=len(last))
            for c in np.unique(at):
                total[c] += x[at == c].sum(0)
        met = np.flatnonzero(n)
        lists = pa.array(total[met].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met]), lists], ["cluster", "n", "total"])

    parts = vectors.select("v").mapInArrow(sums, "cluster int, n bigint, total array<bigint>")
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    rows = parts.groupBy("cluster").agg(wide(F.col("n")).alias("n"), F.array(*[wide(F.col("total")[i]) for i in range(width)]).alias("total")).collect()
    out = last.copy()
    for r in rows:
        out[r["cluster"]] = [int(t) // int(r["n"]) for t in r["total"]]
    return out


def clustered(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that takes part, the final centroids)."""
    python_workers(embeddings.sparkSession)
    vectors = quantised(embeddings, dimensions, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    generations = [first_centroids(vectors, k, seed)]
    if not len(generations[0]):
        return vectors.selectExpr("vec_id", "CAST(NULL AS INT) AS cluster", "CAST(NULL AS BIGINT) AS distance"), generations[0]
    for _ in range(rounds):
        generations.append(moved(vectors, generations))
    return vectors.mapInArrow(_assigning(generations), f"vec_id {kind}, cluster int, distance bigint"), generations[-1]


def _assigning(generations: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at, distance = _replayed(batch, generations)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def digest(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """Per vector: its cluster and squared distance, its cluster's and the whole inertia, and its centroid's hash."""
    rows, centroids = clustered(embeddings, k, rounds)
    rows = cut(rows)
    total = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    hashes = [(c, ",".join(map(str, x))) for c, x in enumerate(centroids.tolist())]
    named = embeddings.sparkSession.createDataFrame(hashes, "cluster int, components string")
    whole = total.agg(F.sum("cluster_inertia").alias("inertia"))  # one row
    side = total.join(named, "cluster").crossJoin(F.broadcast(whole)).select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return lookup(rows, side, ["cluster"], most=k).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
