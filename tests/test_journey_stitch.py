"""Orders stitched through identity links: nothing guessed, reruns change nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import journeystitch as S
from quern.operators import silver as V
from quern.operators.identity import identifier_hash

STITCH = "brand_id string, order_id long, visitor_id string, profile_id long"


def links(spark, *rows):
    df = spark.createDataFrame([(b, t, v, p, a) for b, t, v, p, a in rows], "brand_id string, identifier_type string, v string, profile_id long, is_active boolean")
    return df.withColumn("identifier_hash", identifier_hash("s", "anon_id", F.col("v")))


def visitors(spark, *rows):
    return spark.createDataFrame(list(rows), "brand_id string, visitor_id string")


def ledger(spark, *rows):
    return spark.createDataFrame(list(rows), "brand_id string, order_id long, profile_id long")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_only_customers_with_one_visitor(spark):
    seen = visitors(spark, *[("b", v) for v in ("v1", "v1", "v2", "v3", "v4", "", None)], ("c", "v1"), (None, "v1"))
    named = links(
        spark, ("b", "anon_id", "v1", 1, True), ("b", "anon_id", "v1", 1, True), ("b", "anon_id", "v2", 2, True), ("b", "anon_id", "v3", 2, True), ("b", "anon_id", "v4", 3, False), ("b", "email", "v4", 4, True),
        ("b", "anon_id", "v4", None, True), ("b", "anon_id", "unseen", 1, True), ("b", "anon_id", "v4", 5, None),
    )
    found = S.known_visitors(seen, named, "s")
    assert rows(found) == [("b", 1, "v1", "v1"), ("b", 2, "v2", "v3")]
    out = S.stitched_orders(ledger(spark, ("b", 10, 1), ("b", 10, 1), ("b", 11, 2), ("b", 12, None), ("c", 13, 1), ("b", None, 1)), found)
    assert rows(out) == [("b", 10, "v1", 1)] and rows(S.outcome(found, out)) == [("b", 1, 1)]
    assert rows(S.known_visitors(seen, named, "other salt")) == []


def test_an_order_of_two_customers_is_not_guessed(spark):
    found = spark.createDataFrame([("b", 1, "v1", "v1"), ("b", 2, "v2", "v2"), ("b", 3, "v1", "v1")], "brand_id string, profile_id long, visitor_id string, last_visitor_id string")
    out = S.stitched_orders(ledger(spark, ("b", 1, 1), ("b", 1, 2), ("b", 2, 1), ("b", 2, 3)), found)
    assert rows(out) == [("b", 2, "v1", 1)]


def test_reruns_keep_and_replace(spark):
    old = spark.createDataFrame([("b", 1, "v0", 1), ("b", 2, "v2", 2)], STITCH)
    fresh = spark.createDataFrame([("b", 1, "v1", 1), ("b", 3, "v3", 3)], STITCH)
    once = S.upsert_stitches(old, fresh)
    assert rows(once) == [("b", 1, "v1", 1), ("b", 2, "v2", 2), ("b", 3, "v3", 3)] == rows(S.upsert_stitches(once, fresh))
    assert rows(S.upsert_stitches(old, fresh.limit(0))) == rows(old)


def test_empty(spark):
    found = S.known_visitors(visitors(spark, ("b", None)), links(spark, ("b", "anon_id", "v", 1, True)), "s")
    assert rows(found) == [] and rows(S.stitched_orders(ledger(spark, ("b", 1, 1)), found)) == []


def test_spend_measures_of_odd_events(spark):
    at = "2024-01-01 00:00:00"
    made = [("b", "e1", '{"properties":{"stat_date":"2024-01-01","spend_minor":"5","reach":"x","ctr":"0.5","clicks":null}}', at, at), ("b", "e1", '{"properties":{"stat_date":"2024-01-01","spend_minor":"7"}}', at, at),
            ("b", "", '{"properties":{"stat_date":"2024-01-01"}}', at, at), ("b", None, "{}", at, at), ("b", "e2", '{"properties":{"stat_date":"soon"}}', at, at), ("b", "e3", '{"properties":{"stat_date":"2024-01-01","breakdown_key":"age"}}', at, at), ("b", "e4", "{", at, at), ("b", "e5", None, at, at)]
    events = spark.createDataFrame(made, "brand_id string, event_id string, pj string, occurred_at string, ingested_at string")
    for df in (events, events.repartition(4, "pj")):
        (r,) = V.spend_measures(df).collect()
        assert (r.spend_event_id, r.spend_minor, r.clicks, r.reach) == ("e1", 7, 0, None)
    assert V.spend_measures(events.limit(0)).collect() == []
