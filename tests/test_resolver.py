"""Identity decisions against an event-by-event reading, the command log's inverses, and replays in other orders."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quern.functions.scalars import deterministic_id
from quern.operators import resolver as R

IDS = "brand_id string, event_id long, identifier_type string, identifier_hash string, tier string"
LINKS = "brand_id string, identifier_type string, identifier_hash string, profile_id string, tier string"
TIERS = {"email": "strong", "phone": "strong", "shop": "strong_on_link", "device": "medium", "ip": "weak"}


def drawn(seed, events=300, profiles=25):
    rng = random.Random(seed)
    pick = lambda: (t := rng.choice(list(TIERS)), f"{t[0]}{rng.randrange(18)}")
    links = {("b", *pick(), f"P{rng.randrange(profiles):03d}") for _ in range(60)}
    ids = [("b", e, *i, TIERS[i[0]]) for e in range(events) for i in {pick() for _ in range(rng.randrange(1, 5))}]
    gone = {f"P{i:03d}" for i in range(profiles) if rng.random() < 0.15}
    off = {("phone", f"p{i}") for i in range(18) if rng.random() < 0.2}
    return ids, [(*x, TIERS[x[1]]) for x in sorted(links)], gone, off


def plain(ids, links, gone, off, threshold, guard):
    """What each event decides, one after another, by sets of profiles."""
    owned = {p for _, t, _, p, tier in links if tier in R.STRONG}
    by = {}
    for _, t, h, p, _ in links:
        by.setdefault((t, h), set()).add(p)
    out, new = {}, set()
    for e in {i[1] for i in ids}:
        mine = [(t, h, tier) for _, x, t, h, tier in ids if x == e]
        bad = {(t, h) for t, h, _ in mine if t == "phone" and ((t, h) in off or len(by.get((t, h), ())) + 1 > threshold)}
        strong = [(t, h) for t, h, tier in mine if tier in R.STRONG and (t, h) not in bad]
        matched = set().union(*[by.get(k, set()) for k in strong])
        fresh = any(k not in by for k in strong)
        if len(matched) <= 1:
            devices = {p for t, h, tier in mine if tier == "medium" for p in by.get((t, h), ()) if not (guard and fresh and p in owned)}
            if len(matched | devices) == 1:
                matched |= devices
        low, high = min(matched, default=None), max(matched, default=None)
        action = "minted" if not matched else "linked" if len(matched) == 1 else "skipped" if gone & {low, high} else "merged"
        out[e] = (action, low, high if len(matched) > 1 else None, len(bad))
        if action == "linked":
            new |= {(e, t, h) for t, h, _ in mine if low not in by.get((t, h), ())}
        if action == "minted":
            new |= {(e, t, h) for t, h, tier in mine if not (guard and tier == "medium" and (t, h) in by)}
    return out, new


@pytest.mark.parametrize("seed, guard", [(1, True), (2, True), (3, False)])
def test_decisions_equal_one_event_at_a_time(spark, seed, guard):
    ids, links, gone, off = drawn(seed)
    frames = spark.createDataFrame(ids, IDS).repartition(3), spark.createDataFrame(links, LINKS), spark.createDataFrame([("b", g) for g in gone], "brand_id string, profile_id string"), spark.createDataFrame([("b", *k) for k in off], "brand_id string, identifier_type string, identifier_hash string")
    decisions, new, _ = R.decide(*frames, threshold=3, guard_devices=guard)
    want, want_new = plain(ids, links, gone, off, 3, guard)
    got = {r["event_id"]: (r["action"], None if r["action"] == "minted" else r["profile_id"], r["other_id"], r["suppressed"]) for r in decisions.collect()}
    assert got == want
    assert {(r["event_id"], r["identifier_type"], r["identifier_hash"]) for r in new.collect()} == want_new
    assert {a for a, *_ in got.values()} == {"minted", "linked", "merged", "skipped"} and any(x[3] for x in got.values())


def test_an_unmerge_restores_the_map_and_replays_add_nothing(spark):
    links = [("b", "email", f"e{i}", f"P{i}", "strong") for i in range(6)]
    log = R.commands(
        spark.createDataFrame([("b", i, "merged", f"P{i}", f"P{i + 1}", 0) for i in (0, 1, 4)], "brand_id string, event_id long, action string, profile_id string, other_id string, suppressed long"),
        spark.createDataFrame(links, LINKS), spark.createDataFrame([], "brand_id string, identifier_type string, identifier_hash string"), F.lit("2024-01-01").cast("timestamp"),
    ).cache()
    told = lambda x: {(r["identifier"], r["profile_id"]) for r in R.identity_map(R.folded(x)).collect()}
    alone = told(log.where("kind = 'link'"))
    joined = told(log)
    assert joined == {(f"email:e{i}", f"P{0 if i < 3 else 4 if i > 3 else 3}") for i in range(6)}
    undone = R.compensate(log, (F.col("kind") == "merge") & (F.col("a") == "P1"), F.lit("2024-02-01").cast("timestamp")).cache()
    assert told(undone) == {(f"email:e{i}", f"P{0 if i < 2 else 4 if i > 3 else i}") for i in range(6)}  # P2 alone is out again
    assert told(R.compensate(log, F.col("kind") == "merge", F.lit("2024-02-01").cast("timestamp"))) == alone
    again = R.compensate(undone, ~F.col("is_on"), F.lit("2024-03-01").cast("timestamp"))
    assert told(again) == joined
    assert R.append(undone, log).count() == undone.count() == log.count() + 1
    assert {r["command"] for r in again.collect()} == {"link", "merge", "unmerge", "remerge"}


def chains(n=40):
    rng = random.Random(4)
    rows = []
    for e in range(n):  # chains of four identifiers, each event holding two neighbours, and events of one
        c = rng.randrange(6)
        i = rng.randrange(4)
        rows += [(e, f"k{c}{i}"), (e, f"k{c}{(i + 1) % 4}")] if e % 5 else [(e, f"k{c}{i}")]
    return rows


def alone(batch, known):
    """A rule broken on purpose: an event takes the first profile of its own identifiers and tells no other profile."""
    met = batch.join(known, "key", "left").groupBy("event_id").agg(F.min("profile").alias("_p"), F.min("key").alias("_k"))
    named = batch.join(met, "event_id").select("key", F.coalesce("_p", F.concat(F.lit("p"), "_k")).alias("profile")).groupBy("key").agg(F.min("profile").alias("profile"))
    return known.unionByName(named.join(known, "key", "left_anti"))


def test_replays_agree_and_a_broken_rule_is_found_out(spark):
    events = spark.createDataFrame(chains(), "event_id long, key string")
    report = R.order_report(events, R.replay(events, [1, 2], 2)).collect()
    assert sum(r["identifiers"] for r in report) == len({k for _, k in chains()})
    assert {(r["partitions"], r["differences"]) for r in report} == {(1, 0)}
    broken = R.order_report(events, R.replay(events, [1, 2], 2, rule=alone)).collect()
    assert sum(r["differences"] for r in broken) > 0 and max(r["partitions"] for r in broken) > 1


def test_minted_ids_follow_from_their_identifiers(spark):
    ids = spark.createDataFrame([("b", 1, "email", "e1", "strong"), ("b", 2, "email", "e1", "strong")], IDS)
    none = spark.createDataFrame([], LINKS)
    decisions, new, _ = R.decide(ids, none, none.select("brand_id", "profile_id"), none.select(*R.KEY))
    want = spark.range(1).select(deterministic_id(F.lit("b"), F.lit("email:e1"))).first()[0]
    assert {r["profile_id"] for r in decisions.collect()} == {want} and new.count() == 2
    assert R.commands(decisions, new, none.select(*R.KEY), F.lit("2024-01-01").cast("timestamp")).count() == 2  # one profile, one link
