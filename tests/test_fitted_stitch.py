"""The fitted stitching model against planted rates and all pairs, and blocks that split without losing a link."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import functions as F

from quern.operators import stitch as P

SCHEMA = "brand_id string, visitor_id int, ua_class string, screen_class string, daypart int, active_hours array<int>, top_products array<string>, person string"


def visitors(seed, people=60, strangers=200):
    """Visitors of people, whose device is their own with a known probability, and strangers at random."""
    rng = random.Random(seed)
    any_ua, any_screen = (lambda: f"u{rng.randrange(8)}"), (lambda: f"s{rng.randrange(5)}")
    any_hours, any_products = (lambda: sorted(rng.sample(range(24), 4))), (lambda: sorted({f"p{rng.randrange(40)}" for _ in range(4)}))
    out = []
    for p in range(people):
        own = any_ua(), any_screen(), rng.randrange(4), any_hours(), any_products()
        for _ in range(6):
            keep = [rng.random() < 0.9 for _ in own]
            new = any_ua(), any_screen(), rng.randrange(4), any_hours(), any_products()
            told = [o if k else n for o, n, k in zip(own, new, keep, strict=True)]
            if rng.random() < 0.1:
                told[2] = None
            out.append(("b", len(out), *told, f"P{p}"))
    for _ in range(strangers):
        out.append(("b", len(out), any_ua(), any_screen(), rng.randrange(4), any_hours(), any_products(), None))
    return out


def level(name, x, y):
    if x is None or y is None:
        return None
    if len(P.MODEL[name]) == 2:
        return 0 if x == y else 1
    n = len(set(x) & set(y))
    return next((i for i, s in enumerate(P.SHARED) if n >= s), 3)


def all_pairs(rows, wanted):
    counts = {c: [0] * len(P.MODEL[c]) for c in P.MODEL}
    for a, b in combinations(rows, 2):
        if wanted(a[-1], b[-1]):
            for i, c in enumerate(P.MODEL):
                at = level(c, a[2 + i], b[2 + i])
                if at is not None:
                    counts[c][at] += 1
    return {c: [(x + 0.5) / (sum(n) + 0.5 * len(n)) for x in n] for c, n in counts.items()}


def test_m_is_that_of_all_labelled_pairs_and_u_near_that_of_all_others(spark):
    rows = visitors(1)
    model = P.fit(spark.createDataFrame(rows, SCHEMA).repartition(3))
    m = all_pairs(rows, lambda p, q: p is not None and p == q)
    u = all_pairs(rows, lambda p, q: p is None or p != q)
    for c, levels in model.items():
        assert abs(sum(x for x, _ in levels) - 1) < 1e-9
        for i, (got_m, got_u) in enumerate(levels):
            assert abs(got_m - m[c][i]) < 1e-9 and abs(got_u - u[c][i]) < 0.02
    planted = 0.81 + 0.19 / 8  # both keep their own, or meet by chance
    assert abs(model["ua_class"][0][0] - planted) < 0.06 and abs(model["ua_class"][0][1] - 1 / 8) < 0.02


def test_a_hot_person_and_tenant_are_sampled_in_proportion(spark):
    rows = [("b", i, f"u{i % 2}", "s", 1, [1], ["a"], "P") for i in range(1200)]
    model = P.fit(spark.createDataFrame(rows, SCHEMA), most=32)
    assert abs(model["ua_class"][0][0] - 0.5) < 0.05


def test_split_blocks_lose_no_link(spark):
    rows = visitors(2, people=25, strangers=10)
    rows = [(*r[:-1], None) if r[1] % 6 == 0 and r[-1] else r for r in rows]  # one visitor of each person isn't identified
    df = spark.createDataFrame(rows, SCHEMA).cache()
    model = P.fit(df)
    found = [sorted(map(tuple, P.stitched(df, 0.5, 0.05, model, most=most).collect())) for most in (1, 3, 10_000)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 5
    true = {r[1]: rows[r[1] + 1][-1] for r in rows if r[1] % 6 == 0 and r[1] < 150}
    assert sum(true.get(v) == p for _, v, p, _ in found[0]) > 0.8 * len(found[0])


def test_cells_are_bounded(spark):
    df = spark.createDataFrame(visitors(3, people=1, strangers=900), SCHEMA).withColumn("ua_class", F.lit("hot"))
    a, b = P._in_blocks(df, df, ["brand_id", "ua_class"], 50)
    for side in (a, b):
        most = side.groupBy("brand_id", "ua_class", "_cell").count().agg(F.max("count")).first()[0]
        assert most < 50 * 1.8
    pairs = a.select("visitor_id", "_cell").join(b.select(F.col("visitor_id").alias("other"), "_cell"), "_cell")
    assert pairs.count() == df.count() ** 2 == pairs.distinct().count()
