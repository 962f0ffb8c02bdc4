"""Links among torn buckets: prefixes and blocks against all pairs, at the threshold, below it, and of unlike sizes."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import neardup


def bag(text: str) -> Counter:
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1)))


def ratio(x: Counter, y: Counter) -> float:
    return sum((x & y).values()) / sum((x | y).values())


def sample() -> list[str]:
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = set()
    for size in (40, 104):
        template = fresh(size)
        for own in (0, 2, 5, 8, 11, 12, 15, 25):
            texts |= {" ".join(template + fresh(own)) for _ in range(5)}
    texts |= {" ".join(["again"] * n) for n in (5, 6, 20, 21, 24, 25, 26, 104, 120, 124, 130)}
    texts |= {" ".join(f"{c}{i}" for i in range(100)) + " x" * (c == "a") for c in "ab"}
    base = fresh(104)
    texts |= {" ".join(base), " ".join(base[:84]), " ".join(base[:83])}  # 100 shingles, exactly 80 of them, and 79
    return sorted(texts)


@pytest.mark.parametrize(("most", "per_comp"), [(0, 1), (3, 3), (128, 1), (128, 3)])
def test_no_link_between_components_is_lost(spark, docs_of, most, per_comp):
    texts = sample()
    docs = docs_of(list(enumerate(texts)))
    by_h = docs.select(neardup.digest_of(F.col("text")).alias("h"), "text").cache()
    order = {t: i for i, t in enumerate(texts)}
    comp_of = {bytes(r["h"]): str(order[r["text"]] // per_comp).encode() for r in by_h.collect()}
    rest = spark.createDataFrame([(bytearray(h), bytearray(c)) for h, c in comp_of.items()], "h binary, comp binary")
    got = neardup._joining(rest, lambda hs: by_h.join(hs.distinct(), "h"), 5, 0.8, most, block=8).collect()

    bags = [bag(t) for t in texts]
    name = [str(i // per_comp).encode() for i in range(len(texts))]
    want = {frozenset((name[i], name[j])) for i in range(len(texts)) for j in range(i) if name[i] != name[j] and ratio(bags[i], bags[j]) >= 0.8}
    found = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in got}
    assert found <= want and len(want) > 30

    def classes(links):
        up = {c: c for c in name}

        def top(c):
            while up[c] != c:
                c = up[c]
            return c

        for a, b in map(tuple, links):
            up[top(a)] = top(b)
        groups = {}
        for c in up:
            groups.setdefault(top(c), set()).add(c)
        return {frozenset(g) for g in groups.values()}

    assert classes(found) == classes(want)
    if most == 128:
        assert found == want
