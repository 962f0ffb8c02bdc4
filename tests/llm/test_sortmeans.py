"""Sort-means against plain k-means in whole numbers, its pruning, and odd rows."""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest

from quern.llm import queries, sortmeans

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster int"


def plain(rows, k=16, rounds=3):
    """(vec_id, cluster, distance) of every row that takes part, by all distances, and the centroids."""
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for _ in range(rounds + 1):
        at = [min((gap(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        last = centroids
        centroids = list(centroids)
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, at, strict=True)), key=str), last


def rows_of(n, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, 64))
    return [(i, (centres[i % 5] + rng.normal(0, spread, 64)).tolist()) for i in range(n)]


def framed(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 9) for i, v in rows], SCHEMA)


def test_clusters_equal_plain_k_means(spark):
    rows = rows_of(120)
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]  # repeated ids, equal and not, and none
    rows += [(500, None), (501, [1.0] * 63), (502, [float("nan")] + [0.0] * 63), (503, [None] + [0.0] * 63), (504, [float("inf")] + [0.0] * 63)]
    rows += [(600 + i, [float(i % 2)] * 64) for i in range(12)]  # ties between equal vectors
    want, centroids = plain(rows)
    got = sortmeans.digest(framed(spark, rows).repartition(5)).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == want
    assert {r["inertia"] for r in got} == {sum(d for _, _, d in want)}
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_few_vectors_no_ids_and_empty_tables(spark):
    one = sortmeans.digest(framed(spark, [(3, [0.5] * 64)])).collect()
    assert [(r["cluster"], r["distance"], r["inertia"]) for r in one] == [(0, 0, 0)]
    none = sortmeans.digest(framed(spark, [(None, [0.5] * 64)])).collect()
    assert [(r["vec_id"], r["cluster"], r["inertia"]) for r in none] == [(None, None, None)]
    empty = sortmeans.digest(framed(spark, []))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_too_large_components_say_so(spark):
    with pytest.raises(Exception, match="beyond"):
        sortmeans.digest(framed(spark, [(1, [1e30] + [0.0] * 63)])).collect()


def test_scans_stop_only_strictly_beyond():
    """Every start gives the nearest centroid, ties to the smaller number, and separated clusters are met alone."""
    rng = np.random.default_rng(4)
    grid = rng.integers(-2, 3, (400, 3))  # many equal distances
    centroids = rng.integers(-2, 3, (9, 3))
    gaps = ((grid[:, None] - centroids[None]) ** 2).sum(2)
    for start in range(9):
        best, distance, _ = sortmeans.nearest(grid, centroids, np.full(400, start))
        assert (best == gaps.argmin(1)).all() and (distance == gaps.min(1)).all()
    far = np.arange(9)[:, None] * 1000 + np.zeros((1, 4), np.int64)
    near = np.repeat(far, 50, 0) + rng.integers(-3, 4, (450, 4))
    _, _, taken = sortmeans.nearest(near, far, np.repeat(np.arange(9), 50))
    assert taken == 450  # none but the start's own


def test_query_equals_duckdb(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tables}/embeddings.parquet'")
    rel = con.sql(queries.ORACLES["op11_sort_means"])
    got = queries.op11_sort_means(spark, tables)
    assert set(rel.columns) == set(got.columns)
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())
