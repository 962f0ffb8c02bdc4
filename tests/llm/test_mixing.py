"""The mix: targets both ways with repeated rows, exact quotas, draws against enumeration, shards and local order."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing


def by_source(rows, got):
    """Per source: (target, words taken, largest row)."""
    source = {r[0]: r[3] for r in rows}
    words, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        words[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
    return {s: (target[s], words[s], largest[s]) for s in target}


@pytest.mark.parametrize("repeats", [False, True])
def test_each_source_is_within_a_row_of_its_target(docs_of, repeats):
    rng = random.Random(8)
    rows = [(1000 * k + (0 if repeats else i), "w " * (5 if repeats else rng.randrange(0, 40)), "en", s) for k, s in enumerate("abcdefg") for i in range(60 * (k + 1))]
    rows = [(None, "w w", "en", None), *rows]
    got = [r.asDict() for r in mixing.digest(docs_of(rows), block_words=300).collect()]
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    for target, words, largest in by_source(rows, got).values():
        assert target - largest <= words <= target + 1e-6
    assert all(len(r["shards"].split(",")) == r["copies"] for r in got if r["copies"])


def test_draws_equal_enumerated_probabilities(spark):
    n, k, d = 9, 4, 5
    want, steps = [], 4000
    for x in range(max(0, d - (n - k)), min(k, d) + 1):
        want += [(x, Fraction(comb(k, x) * comb(n - k, d - x), comb(n, d)))]
    u = spark.range(steps).select(((F.col("id") + 0.5) / steps).alias("u"))
    got = Counter(r[0] for r in u.select(mixing.hypergeometric(F.lit(n), F.lit(k), F.lit(d), F.col("u"))).collect())
    for x, p in want:
        assert abs(got[x] / steps - float(p)) <= 2 / steps
    assert sum(got.values()) == steps


def test_quotas_are_split_exactly_and_in_halves(spark):
    sources = [(i, (i * 37) % 50) for i in range(600)]
    rows = mixing.split_quotas(spark.createDataFrame(sources, "sid int, quota long"), 3).collect()
    of, shard = Counter(), Counter()
    for r in rows:
        assert r["quota"] >= 0
        of[r["sid"]] += r["quota"]
        shard[r["shard"]] += r["quota"]
    assert [of[i] for i, _ in sources] == [q for _, q in sources]
    assert set(shard) == set(range(8)) and max(shard.values()) - min(shard.values()) <= 1


def test_means_of_a_draw_are_in_proportion(spark):
    quotas = spark.createDataFrame([(0, 30), (1, 10)], "sid int, quota long")
    left = [next(r["quota"] for r in mixing.split_quotas(quotas, 1, seed).collect() if r["sid"] == 0 and r["shard"] == 0) for seed in range(20)]
    assert 13 <= sum(left) / 20 <= 17 and len(set(left)) > 1


def test_shards_hold_what_the_plan_says_in_random_order(docs_of):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), "en", rng.choice("abb")) for i in range(600)] + [(900, "r r r", "en", "a")] * 40
    docs = docs_of(rows).selectExpr("*", "7 as shard")
    want = Counter()
    for r in mixing.digest(docs, block_words=400).collect():
        for s in r["shards"].split(",") if r["shards"] else []:
            want[r["doc_id"], int(s)] += 1
    out = mixing.materialise(docs, block_words=400).withColumn("at", F.spark_partition_id())
    got = out.collect()
    assert out.columns == [*docs.columns, "shard_", "piece", "at"] and Counter((r["doc_id"], r["shard_"]) for r in got) == want
    assert all(len({r["at"] for r in got if r["shard_"] == s}) == 1 for s in range(16))
    first = [r["doc_id"] for r in got if r["shard_"] == got[0]["shard_"]]
    assert first != sorted(first)
    assert Counter(r["doc_id"] for r in mixing.mixed(docs, block_words=400).collect()) == Counter(d for (d, _), n in want.items() for _ in range(n))
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs.limit(0)).count() == 0 and mixing.digest(docs.limit(0)).count() == 0


def test_odd_rows(docs_of):
    rows = [(1, None), (1, None), (2, ""), (None, "a b"), (3, "x" * 100_000), (4, "a " * 50_000, "en", None)]
    assert len(mixing.digest(docs_of(rows)).collect()) == len(rows)
    assert mixing.mixed(docs_of(rows[:3])).count() == 0
