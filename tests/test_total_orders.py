"""Silver folds over rows that tie in every key: one result, however rows are arranged."""

from __future__ import annotations

import json

import pytest

from quern.operators import silver as V
from test_oracles import compare


TIED = ["s12_return_state", "s14_fulfillment", "s19_cod_outcome", "s17_spend_facts", "g37_journey_ledger", "s18_campaign"]




@pytest.mark.parametrize("name", TIED)
def test_oracles_where_lines_repeat(name, spark):
    compare(name, spark, "/root/testdata/sf0.01")


def arranged(spark, rows, schema):
    for parts in (1, 3, 7):
        for flip in (False, True):
            yield spark.createDataFrame(rows[::-1] if flip else rows, schema).repartition(parts)


def test_equal_keys_with_other_content_give_one_row(spark):
    at = "2024-01-01 00:00:00"
    told = lambda **p: json.dumps({"properties": {"order_id": "1", **p}})
    returns = [("b", 5, at, told(status=s, courier=c, status_changed_at=at)) for s in ("x", "y", "z") for c in ("c1", None, "c2")]
    got = {tuple(r) for df in arranged(spark, returns, "brand_id string, event_id long, occurred_at string, pj string") for r in V.return_states(df.selectExpr("brand_id", "event_id", "cast(occurred_at as timestamp) occurred_at", "pj")).collect()}
    assert len(got) == 1 and next(iter(got))[2:6] == ("z", "none", False, "c2")
    ships = [("b", 5, at, told(fulfillment_id="f", status=s)) for s in ("open", "success", None)]
    got = set()
    for df in arranged(spark, ships, "brand_id string, event_id long, occurred_at string, pj string"):
        rows = df.selectExpr("brand_id", "event_id", "cast(occurred_at as timestamp) occurred_at", "cast(occurred_at as timestamp) ingested_at", "pj")
        got |= {r["status"] for r in V.fulfillments(rows).collect()}
    assert got == {"success"}
