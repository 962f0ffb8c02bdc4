"""Exact top-k: the index prunes on proof, huge components are exact or refused, queries meet every block."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.llm import topk


def best(ids, v, q, i, k=5):
    scores = [(-sum(int(a) * int(b) for a, b in zip(v[j], q, strict=True)), int(ids[j])) for j in range(len(ids)) if ids[j] != i]
    return [(n, -s) for s, n in sorted(scores)[:k]]


@pytest.mark.parametrize("kind", ["unit", "skewed", "ties", "sparse", "one sign"])
def test_pruned_results_are_exact(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    if kind == "skewed":
        x *= np.exp(-np.arange(24) / 4)
    if kind == "ties":
        x = np.sign(x)
    if kind == "sparse":
        x *= rng.random(x.shape) < 0.1
    if kind == "one sign":
        x = np.abs(x)
    v = np.floor(256 * x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.int64)
    ids = np.arange(1500)
    block = topk.Block(ids, v)
    for i in range(0, 1500, 50):
        found, scores = block.top(i, v[i], 5)
        assert list(zip(found.tolist(), scores.tolist(), strict=True)) == best(ids, v, v[i], i)


def test_few_rows_are_scored_whole(tables):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{tables.replace('0.001', '0.1')}/embeddings.parquet")
    v = np.floor(np.array(t["embedding"].to_pylist(), np.float32).astype(float) * 256).astype(np.int64)
    ids = t["vec_id"].to_numpy()
    block = topk.Block(ids, v)
    for i in np.flatnonzero(ids % 50 == 0):
        block.top(int(ids[i]), v[i], 5)
    assert block.scored <= 0.2 * block.asked and block.read <= 0.7 * block.asked * v.shape[1]


def test_huge_components_are_exact_or_refused(spark):
    rows = [(0, [1e6, 2e6]), (1, [1e7, -1e6]), (2, [3e7, 1e3]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    v = [[int(256 * x) for x in e] for _, e in rows]
    assert got == best(np.arange(4), v, v[0], 0)
    with pytest.raises(PySparkException):
        topk.top_k(spark.createDataFrame([(0, [3e38]), (1, [3e38])], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    with pytest.raises(PySparkException):
        topk.top_k(spark.createDataFrame([(0, [1e15]), (1, [1e15])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_all_blocks_meet_all_queries(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 6))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>").selectExpr("*", "1 as block", "2 as query", "3 as dims")
    whole = np.floor(v * 256).astype(np.int64)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 3 == 0, block_rows=50, query_rows=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: [(i, s) for _, i, s in sorted(rows)] for q, rows in got.items()} == {i: best(np.arange(400), whole, whole[i], i) for i in range(0, 400, 3)}
