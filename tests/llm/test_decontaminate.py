"""Decontamination against an exhaustive edit search, at the full limit of edits, with short items and odd ids."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import decontaminate
from quern.llm.bytetext import slices, words


def hashed(texts):
    (_, _, raw, offsets) = next(iter(slices(pa.array(texts, pa.large_string()), 1 << 30)))
    h, _, _, first = words(raw, offsets)
    return h, first


def edited(rng, w, n, kind):
    w = w[:]
    spots = sorted(rng.sample(range(len(w)), n), reverse=True)
    for p in spots:
        if kind == "change":
            w[p] = f"zz{rng.randrange(10**6)}"
        elif kind == "leave out":
            del w[p]
        else:
            w.insert(p, f"zz{rng.randrange(10**6)}")
    return w


@pytest.mark.parametrize("n", [5, 6, 8, 10, 15, 20, 40])
def test_items_at_the_limit_of_edits_are_found(n):
    rng = random.Random(n)
    some = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    items = [some(n) for _ in range(300)]
    index = decontaminate.Index(list(range(300)), [" ".join(w) for w in items])
    for kind in ("change", "leave out", "put in"):
        texts = [" ".join(some(30) + edited(rng, w, int(0.2 * n), kind) + some(30)) for w in items]
        hits = {(t, i) for t, i, _, _ in index.verified(*hashed(texts))}
        assert sum((i, i) in hits for i in range(300)) >= 0.98 * 300, kind


def test_matches_equal_an_exhaustive_search():
    rng = random.Random(7)
    some = lambda k: [f"w{rng.randrange(40)}" for _ in range(k)]
    items = [some(rng.randrange(1, 18)) for _ in range(60)]
    texts = [some(rng.randrange(0, 60)) for _ in range(60)]
    for t, w in zip(texts, items, strict=True):
        at = rng.randrange(len(t) + 1)
        t[at:at] = edited(rng, w, rng.randrange(0, int(0.2 * len(w)) + 1), rng.choice(["change", "leave out", "put in"]))
    index = decontaminate.Index(list(range(60)), [" ".join(w) for w in items])
    h, first = hashed([" ".join(t) for t in texts])
    got = {(t, i): d for t, i, d, _ in index.verified(h, first)}
    want = {}
    for t in range(60):
        for i, item in enumerate(index.items):
            if first[t + 1] > first[t]:
                d = int(decontaminate.edit_distance(item, h[first[t] : first[t + 1]][None, :])[0][0])
                if d <= int(0.2 * len(item)):
                    want[t, i] = d
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got) and len(got) >= 0.98 * len(want)
    assert {k for k in want if len(items[k[1]]) < 5} <= set(got)  # without room for an edit nothing is left to chance


def test_short_items_repeats_and_string_ids(spark):
    docs = spark.createDataFrame([("d1", "Here stand: four plain words, yes."), ("d1", "Here stand: four plain words, yes."), (None, "plain four words"), ("d3", None)], "doc_id string, text string")
    bench = spark.createDataFrame([("a", "four plain WORDS yes"), ("b", "words"), ("b", "words"), ("c", " . "), ("d", "word")], "item_id string, text string")
    got = sorted((r["doc_id"] or "", r["item_id"], r["distance"], r["item_words"], r["last_word"]) for r in decontaminate.matches(docs, bench).collect())
    assert got == [("", "b", 0, 1, 2)] * 2 + [("d1", "a", 0, 4, 5)] * 2 + [("d1", "b", 0, 1, 4)] * 4
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()] == ["d3"]


def test_long_items_are_verified_in_bounded_pieces():
    rng = random.Random(3)
    item = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    index = decontaminate.Index([1], [" ".join(item)])
    text = " ".join(item[:700] + ["x"] * 20 + item[720:])
    found = index.verified(*hashed([text, "unrelated words here"]))
    assert [(t, i, d) for t, i, d, _ in found] == [(0, 0, 20)]
    assert np.array_equal(index.items[0], hashed([" ".join(item)])[0])
