"""Saved rules, acquisition members, confidence and forms at their edges."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import confidence, segments, silver
from quern.plans import members

PROFILES = [("b0", 1, 3, "email"), ("b0", 2, None, None), ("b0", 3, 0, "email"), ("b1", 4, 3, "email"), ("b0", None, 9, "email")]


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame(PROFILES, "brand_id string, profile_id long, orders int, acquisition_source string")


def ids(profiles, rule):
    return [r["profile_id"] for r in profiles.where(segments.predicate(rule, profiles.columns)).collect()]


def test_rules(profiles):
    few = {"field": "orders", "op": "lt", "value": 3}
    assert ids(profiles, few) == [3] and ids(profiles, {"not": few}) == [1, 2, 4, None]
    assert ids(profiles, {"not": {"not": few}}) == [3]
    assert ids(profiles, {"field": "orders", "op": "missing"}) == [2]
    assert ids(profiles, {"field": "orders", "op": "ne", "value": 3}) == [3, None]
    assert ids(profiles, {"all": []}) == [1, 2, 3, 4, None] and ids(profiles, {"any": []}) == []
    for bad in ({"field": "x", "op": "eq", "value": 1}, {"field": "orders", "op": "like", "value": "1"}, {}, {"all": [], "any": []}):
        with pytest.raises(ValueError):
            segments.predicate(bad, profiles.columns)


def test_preview_keeps_to_its_brand_and_bounds_its_rules(spark, profiles):
    rule = json.dumps({"field": "orders", "op": "ge", "value": 1})
    saved = spark.createDataFrame([("b0", "s", rule), ("b1", "s", rule), ("b7", "s", rule)], "brand_id string, segment_id string, definition string")
    got = sorted(tuple(r) for r in segments.preview(profiles, saved).collect())
    assert got == [("b0", "s", "has_data", 2, 4), ("b1", "s", "has_data", 1, 1), ("b7", "s", "no_data", None, None)]
    assert segments.preview(profiles, saved.limit(0)).count() == 0
    assert {r["state"] for r in segments.preview(profiles.limit(0), saved).collect()} == {"no_data"}
    with pytest.raises(ValueError):
        segments.preview(profiles, saved, most=2)


def test_acquisition_members(profiles):
    got = lambda *a, **o: [r["profile_id"] for r in segments.acquired_by(profiles, *a, **o).collect()]
    assert sorted(got("b0", " email ")) == [1, 3] and got("b0", "email", most=1) == [1]
    assert got("b0", "  ") == got("b0", None) == got("b9", "email") == []


def test_only_strong_matches_are_exact(spark):
    rows = [("none", None, None, None, None), ("link", ["a", "a"], ["b"], 95, None), ("merge", ["a", "b"], None, 0, False), ("conflict", ["a"], None, 0, True), ("adopt", [], ["a", "a"], 95, True), ("ambiguous", [], ["a", "b"], 0, None), ("weak", [], ["a", "b"], 300, None)]
    schema = "name string, strong_ids array<string>, medium_ids array<string>, weak_score int, conflict boolean"
    evidence = spark.createDataFrame(rows, schema).withColumn("brand_id", F.lit("x"))

    def run(**own):
        settings = spark.createDataFrame([("x", *own.values())], "brand_id string, " + ", ".join(f"{n} int" for n in own)) if own else None
        return {r["name"]: (r["score"], r["band"], r["decision"]) for r in confidence.assessed(evidence, settings).collect()}

    assert run() == {
        "none": (0, "none", "mint"), "link": (100, "exact", "link"), "merge": (100, "exact", "merge"), "conflict": (99, "high", "review"),
        "adopt": (60, "medium", "adopt"), "ambiguous": (0, "none", "mint"), "weak": (99, "high", "review"),
    }
    assert run(adoption=150)["adopt"] == (99, "high", "adopt")
    assert run(exact=90, adoption=95)["adopt"] == (89, "high", "adopt") and run(exact=90)["merge"] == (90, "exact", "merge")
    assert run(medium=61)["adopt"][1] == "low" and run(exact=101)["link"][1:] == ("high", "review")


def test_forms_hold_nothing_that_was_entered(spark, tables):
    forms = silver.form_submissions(members.form_events(spark, tables)).cache()
    assert forms.count() == forms.select("brand_id", "event_id").distinct().count() < members.form_events(spark, tables).count()
    assert not any("entered" in str(tuple(r)) for r in forms.collect())
