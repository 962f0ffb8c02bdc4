"""Components of long chains: labels are final, however ids are ordered along a chain."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from quern.operators import identity as I


def test_components_of_shuffled_paths(spark):
    rng = random.Random(3)
    ids = list(range(4000))
    rng.shuffle(ids)
    long, short = ids[:2000], ids[2000:2100]
    edges = [*zip(long, long[1:]), *zip(short, short[1:]), (5000, 5000)]
    got = {r["node"]: r["component"] for r in I.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: min(long) for n in long} | {n: min(short) for n in short} | {5000: 5000}
    star = [(0, i) for i in range(1, 300)] + [(i, 1000 + i) for i in range(1, 300)] + [(3000 + i, 3001 + i) for i in range(40)]
    rounds = {r["node"]: r["component"] for r in I.components(spark.createDataFrame(star, "a int, b int"), few=4).collect()}
    assert len(rounds) == 640 and all(c == (0 if n < 3000 else 3000) for n, c in rounds.items())


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    name = [hashlib.md5(str(i).encode()).digest() for i in range(600)]
    pairs = [(rng.randrange(600), rng.randrange(600)) for _ in range(330)] + [(7, i) for i in range(560, 600)]
    top = {i: i for p in pairs for i in p}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        top[root(a)] = root(b)
    groups: dict[int, list[bytes]] = {}
    for i in top:
        groups.setdefault(root(i), []).append(name[i])
    want = {n: min(g) for g in groups.values() for n in g}
    edges = spark.createDataFrame([(name[a], name[b]) for a, b in pairs] + [(None, name[0])], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["component"]) for r in I.components(edges).collect()}
    assert got == want
    assert I.components(edges.where(F.lit(False))).count() == 0
