"""Settlements: odd payloads, missing keys, and versions alike in all but their content."""

from __future__ import annotations

import json
from datetime import datetime

from quern.operators import silver

AT = datetime(2024, 1, 1)


def body(**p):
    return json.dumps({"properties": p})


def test_settlements_of_odd_events(spark):
    rows = [
        ("b", "e1", AT, AT, body(status="a", amount_minor="5")), ("b", "e1", AT, AT, body(status="b", amount_minor="7")), ("b", "e2", AT, AT, "no json"), ("b", "e3", AT, AT, None),
        (None, "e4", AT, AT, body()), ("b", None, AT, AT, body()), ("b", "e5", AT, AT, body(amount_minor=12, dispute_direction="debit", settlement_at="2024-02-30")),
    ]
    schema = "brand_id string, event_id string, occurred_at timestamp, ingested_at timestamp, pj string"
    seen = set()
    for order in (rows, rows[::-1]):
        got = silver.settlement_details(spark.createDataFrame(order, schema).repartition(3)).collect()
        seen.add(tuple(sorted((r["event_id"], r["status"] or "", r["amount_minor"], r["currency_code"], r["dispute_direction"] or "", r["settlement_at"] is None) for r in got)))
    assert len(seen) == 1
    (only,) = seen
    assert [r[0] for r in only] == ["e1", "e2", "e3", "e5"]
    assert only[0][1:3] == ("b", 7) and only[1][1:4] == ("", 0, "INR") and only[2][2] == 0 and only[3][2:] == (12, "INR", "debit", True)
