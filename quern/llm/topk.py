"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Components are quantised to integers, which are the impacts. Vectors are dealt into blocks of
bounded size; a block's index holds, for each dimension, its postings by descending magnitude, cut
into segments of equal quantised magnitude. A query takes the segments of all dimensions by
descending product of its own component's magnitude with the segment's, stage by stage. After a stage
the best so far are scored exactly, so the k-th of them is a proven bound. What a vector can still get is at most
the stage's threshold for each dimension that it hasn't been met in, and, of dimensions that
nothing has been met in, their largest product. Only vectors that can reach the bound can be members; no
others are ever left out. A further stage is taken while its postings are fewer than the components of
the vectors that are still possible; those are then rescored from their whole vectors.

Queries are a stated part of all rows; they meet the index in blocks, so each pair of blocks is one
row. Pairs are dealt over tasks so that those of an index block follow each other, and its index is
built once a task; only k rows a query leave a block.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor
do rows without vec_id; components and scores must fit into 64 bits, else an error says so;
vectors of other lengths than the query's don't compare with it; rows that
repeat a vec_id are candidates each, but never of queries of that vec_id; a query that is repeated is
answered once for each row; ties go to the smaller vec_id, then all k ranks are filled; an empty
table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, python_workers

K = 5
SCALE = 256
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
TASK_PAIRS = 4
LEVELS = 16
STAGES = (0.3, 0.5, 0.6, 0.75)  # shares of all postings after which members are counted


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the rows that take part, components as floor(scale * x)."""
    x = F.col("embedding")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, fine)
    fits = lambda v: F.when(F.abs(v) < 2.0**63, F.floor(v).cast("bigint")).otherwise(F.raise_error(F.lit("a component doesn't fit into 64 bits")).cast("bigint"))
    whole = F.transform(x, lambda c: fits(c.cast("double") * scale))
    return embeddings.where(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))


class Block:
    """The impact-ordered index of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        size = np.abs(vectors.astype(np.float64))
        self.reach = float(size.max(initial=0))
        self.whole = vectors.astype(np.float64)  # for exact products in floating point while they are under 2**53
        self.order = np.ascontiguousarray(np.argsort(-size, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.take_along_axis(self.whole, self.order.T, axis=0).T)
        self.high = np.abs(self.values[:, 0]) if len(ids) else np.zeros(len(self.values))
        # A segment of a dimension: its postings with magnitudes from one level down to the next.
        edges = [np.searchsorted(-np.abs(v), -h * np.arange(LEVELS - 1, -1, -1) / LEVELS, "right") for v, h in zip(self.values, self.high, strict=True)]
        self.ends = np.maximum.accumulate(np.array(edges).reshape(len(self.values), LEVELS), axis=1)
        self.ends[:, -1] = len(ids)
        starts = np.concatenate((np.zeros((len(self.values), 1), np.int64), self.ends[:, :-1]), axis=1)
        top = np.take_along_axis(np.abs(self.values), np.minimum(starts, max(len(ids) - 1, 0)), axis=1) if len(ids) else np.zeros(self.ends.shape)
        self.tops = np.where(starts < self.ends, top, 0.0)  # the largest magnitude in a segment
        self.sizes = self.ends - starts
        self.read = self.scored = self.asked = 0

    def _scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.scored += len(rows)
        most = self.reach * float(np.abs(q.astype(np.float64)).sum())
        if most < 2**53:
            return (self.whole[rows] @ q.astype(np.float64)).astype(np.int64)
        if most < 2**62:
            return self.vectors[rows] @ q
        return np.array([int(x) for x in self.vectors[rows].astype(object) @ q.astype(object)] or [], np.int64)  # raises where 64 bits are too few

    def _possible(self, alive: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """The vectors that can be among the k best."""
        weight = np.abs(q.astype(np.float64))
        impact = (weight[:, None] * self.tops).ravel()
        order = np.argsort(-impact, kind="stable")
        upto = np.cumsum(self.sizes.ravel()[order])
        acc, met = np.zeros(len(self.ids)), np.zeros(len(self.ids), np.int32)
        done = np.zeros(len(weight), np.int64)  # segments of each dimension that are read
        candidates, first = alive, 0
        for share in STAGES:
            last = int(np.searchsorted(upto, share * upto[-1])) + 1
            postings = upto[min(last, len(upto)) - 1] - (upto[first - 1] if first else 0)
            if first and postings >= len(candidates) * len(weight):
                break
            # Impacts fall along a dimension, so a stage's segments of a dimension follow those before.
            taken = np.bincount(order[first:last] // LEVELS, minlength=len(weight))
            for d in np.flatnonzero(taken):
                low, high = self.ends[d, done[d] - 1] if done[d] else 0, self.ends[d, done[d] + taken[d] - 1]
                rows = self.order[d, low:high]
                acc[rows] += q[d] * self.values[d, low:high]
                met[rows] += 1
                done[d] += taken[d]
            self.read += int(postings)
            first = last
            if last >= len(order):
                rest = np.zeros(len(candidates))
            else:
                ahead = impact[order[last]]
                begun = done > 0
                rest = (begun.sum() - met[candidates]) * ahead + np.minimum(weight * self.high, ahead)[~begun].sum()
            so_far = acc[candidates]
            best = candidates[np.argpartition(-so_far, 2 * k)[: 2 * k]] if len(candidates) > 2 * k else candidates
            bound = np.partition(self._scores(best, q), len(best) - k)[len(best) - k]
            candidates = candidates[so_far + rest >= bound - 1e-6 * max(1.0, abs(float(bound)))]
            if len(candidates) <= 2 * k or last >= len(order):
                break
        return candidates

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vec_id, score) of the k best vectors of the block, ties to smaller ids."""
        alive = np.flatnonzero(self.ids != query_id)
        self.asked += len(alive)
        candidates = self._possible(alive, q, k) if len(alive) > 4 * k and q.any() else alive
        scores = self._scores(candidates, q)
        best = np.lexsort((self.ids[candidates], -scores))[:k]
        return self.ids[candidates][best], scores[best]


def _packed(rows: DataFrame, block: Column, name: str) -> DataFrame:
    """One row per block and vector length: its ids and its components, concatenated."""
    listed = F.array_sort(F.collect_list(F.struct("vec_id", "v")))
    packed = rows.groupBy(block.alias(name), F.size("v").alias("dims")).agg(listed.alias("_rows"))
    return packed.select(name, "dims", F.transform("_rows", lambda r: r["vec_id"]).alias(f"{name}_ids"), F.flatten(F.transform("_rows", lambda r: r["v"])).alias(f"{name}_v"))


def top_k(
    embeddings: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """Per query row and rank from 1: query_id, rank, vec_id, score; ``is_query`` is a condition on vec_id."""
    spark = embeddings.sparkSession
    python_workers(spark)
    rows = cut(quantised(embeddings, scale))
    queries = rows.where(is_query)
    n_blocks = rows.count() // block_rows + 1
    n_queries = queries.count() // query_rows + 1
    # Blocks are dealt by row, not by key, so copies of one vector spread over them; they are of like sizes.
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v", F.col("_n")), F.lit(n))
    rows = cut(rows.withColumn("_n", F.monotonically_increasing_id()))
    blocks = _packed(rows, deal(n_blocks), "block").withColumn("query", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    asked = _packed(rows.where(is_query), deal(n_queries), "query")
    both = blocks.withColumn("query", F.col("query").cast("bigint")).join(asked, ["query", "dims"])
    run = F.floor(F.col("query") / TASK_PAIRS)
    both = both.repartition(n_blocks * -(-n_queries // TASK_PAIRS), "block", run).sortWithinPartitions("block", "dims")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, block = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if at != (row.block, row.dims):
                    ids, v = np.asarray(row.block_ids, np.int64), np.asarray(row.block_v, np.int64).reshape(-1, row.dims)
                    at, block = (row.block, row.dims), Block(ids, v)
                asked_ids, asked_v = np.asarray(row.query_ids, np.int64), np.asarray(row.query_v, np.int64).reshape(-1, row.dims)
                best = [block.top(int(i), q, k) for i, q in zip(asked_ids, asked_v, strict=True)]
                n = [len(f) for f, _ in best]
                place = (int(row.query) << 32) + np.repeat(np.arange(len(best)), n)
                found, scores = (np.concatenate([b[i] for b in best]) for i in (0, 1))
                yield pd.DataFrame({"query_id": np.repeat(asked_ids, n), "at": place, "dims": np.int32(row.dims), "vec_id": found, "score": scores})

    found = both.select("block", "query", "dims", "block_ids", "block_v", "query_ids", "query_v").mapInPandas(
        search, "query_id bigint, at bigint, dims int, vec_id bigint, score bigint"
    )
    best = Window.partitionBy("query_id", "at", "dims").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
