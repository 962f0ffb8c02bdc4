"""The customer profile: refolds of changed customers, odd rows, the timeline's limit, merged-away customers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from test_oracles import compare

from quern.operators import profile as P
from quern.plans import profiles
from quern.session import stored

TOUCH = "brand_id string, profile_id long, visitor_id long, occurred_at timestamp, touch_seq long, event_type string, channel string, page_type string, product_handle string, order_id string, is_first_touch boolean"
STATE = "brand_id string, profile_id long, order_id long, state string, placed_at timestamp"
CUSTOMER = "brand_id string, profile_id long, lifetime_orders long, lifetime_value_minor long, currency_code string, first_seen_at timestamp, last_seen_at timestamp, first_identified_at timestamp, customer_watermark timestamp"


def rows(spark, schema, *items):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in items], schema)


def at(spark, df):
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c.endswith("_at") else c for c in df.columns])


def fold(spark, customers, states=(), touches=(), views=(), lines=()):
    def text_times(schema):
        return schema.replace("timestamp", "string")

    return P.profiles(
        at(spark, rows(spark, text_times(CUSTOMER), *customers)), at(spark, rows(spark, text_times(STATE), *states)), at(spark, rows(spark, text_times(TOUCH), *touches)),
        rows(spark, "brand_id string, visitor_id long, device string", *views), rows(spark, "brand_id string, order_id long, title string", *lines), "2024-03-01",
    )


ANNA = {"brand_id": "b", "profile_id": 1, "lifetime_orders": 2, "lifetime_value_minor": -7, "last_seen_at": "2024-02-01"}


def test_oracle_on_more_rows(spark):
    compare("g17_profile_whole", spark, "/root/testdata/sf0.01")


def test_refold_of_changed_equals_a_whole_fold(spark, tables):
    whole = profiles.whole_profile(spark, tables)
    changed = whole.where("profile_id % 3 = 1").select(*P.KEYS)
    part = profiles.whole_profile(spark, tables, changed=stored(changed.unionByName(changed)))
    want = sorted(map(str, whole.where("profile_id % 3 = 1").collect()))
    assert sorted(map(str, part.collect())) == want and want


def test_customer_without_anything_else(spark):
    (r,) = fold(spark, [ANNA]).collect()
    assert (r.delivered_orders, r.frequency, r.health_score, r.health_band, r.lifecycle_stage, r.journey_summary) == (0, None, None, None, None, None)
    assert r.aov_minor == -3 and r.last_activity_at == r.last_seen_at and r.monetary_score == 1 and r.days_since_last_order == 29


def test_unknown_recency_is_neither_churned_nor_vip(spark):
    (r,) = fold(spark, [ANNA | {"last_seen_at": None, "lifetime_orders": 0, "lifetime_value_minor": None}]).collect()
    assert (r.churn_risk, r.churn_score, r.segment, r.recency_score, r.aov_minor) == ("low", 15, "cart_abandoner", 1, None)


def test_modes_first_touch_and_ties(spark):
    t = lambda n, **kw: {"brand_id": "b", "profile_id": 1, "visitor_id": 5, "touch_seq": n, "occurred_at": f"2024-01-0{n} 10:00:00", "event_type": "view", "is_first_touch": n == 1} | kw
    touches = [t(1, channel=""), t(2, channel="b"), t(3, channel="a"), t(4, channel=None), t(4, profile_id=None, channel="z")]
    views = [{"brand_id": "b", "visitor_id": 5, "device": d} for d in ("x", "w", "", None, "", "")] + [{"brand_id": "c", "visitor_id": 5, "device": "x"}]
    states = [{"brand_id": "b", "profile_id": 1, "order_id": o, "state": s, "placed_at": "2024-02-20"} for o, s in ((1, "refunded"), (2, "delivered"))]
    lines = [{"brand_id": "b", "order_id": 1, "title": c} for c in ("u", "t", "", None)] + [{"brand_id": "b", "order_id": 9, "title": "t"}]
    (r,) = fold(spark, [ANNA], states, touches, views, lines).collect()
    assert (r.preferred_channel, r.acquisition_source, r.preferred_device, r.top_category) == ("a", "b", "w", "t")
    assert (r.delivered_orders, r.refunded_orders, r.frequency, r.health_score, r.lifecycle_stage) == (1, 1, 2, 70, "active")
    assert r.last_activity_at.day == 4
    line = json.loads(r.journey_summary)
    assert [x["seq"] for x in line] == [1, 2, 3, 4] and line[0] == {"seq": 1, "ts": "2024-01-04T10:00:00Z", "event_type": "view", "is_first_touch": False}


def test_timeline_holds_the_newest_of_a_hot_customer(spark):
    touches = spark.range(5000).select(
        (F.col("id") % 1).cast("string").alias("brand_id"), (F.col("id") % 1).alias("profile_id"), (F.col("id") % 7).alias("visitor_id"), F.timestamp_seconds(F.col("id") * 60).alias("occurred_at"), F.col("id").alias("touch_seq"), F.lit('say "x"\\').alias("event_type"),
        *[F.lit(None).cast("string").alias(c) for c in ("channel", "page_type", "product_handle", "order_id")], F.lit(False).alias("is_first_touch"),
    )
    (r,) = P.timeline(touches.unionByName(touches)).collect()
    line = json.loads(r.journey_summary)
    assert len(line) == P.TIMELINE and line[0]["ts"] == line[1]["ts"] == "1970-01-04T11:19:00Z" and line[0]["event_type"] == 'say "x"\\'
    assert "WindowGroupLimit" in P.timeline(touches)._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark):
    assert fold(spark, []).collect() == []


@pytest.mark.parametrize("bands, stays", [([], True), ([(True, None)], True), ([(False, None)], False), ([(True, "2024-01-01")], False), ([(True, "2024-01-01"), (True, None)], True), ([(None, None)], False)])
def test_merged_away(spark, bands, stays):
    mapping = rows(spark, "brand_id string, profile_id long, is_current boolean, system_to string", *[{"brand_id": "b", "profile_id": 1, "is_current": c, "system_to": t} for c, t in bands])
    assert P.without_merged(fold(spark, [ANNA]), mapping).count() == int(stays)
