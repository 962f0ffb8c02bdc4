"""The make-up of realised revenue at the edges of its day."""

from __future__ import annotations

from datetime import datetime

from quern.operators.recognition import composition


def test_day_is_inside_and_provisional_is_out(spark):
    row = lambda kind, amount, *at, currency="INR": ("b", kind, currency, amount, datetime(*at))
    made = [
        row("finalization", 5, 2024, 1, 2, 23, 59), row("finalization", 7, 2024, 1, 3), row("refund", -2, 2024, 1, 1), row("refund", -1, 2024, 1, 1, currency="KWD"),
        row("provisional_recognition", 9, 2024, 1, 1), row("cancellation", None, 2024, 1, 1), (None, "refund", "INR", 3, datetime(2024, 1, 1)), ("b", "refund", "INR", 3, None),
    ]
    ledger = spark.createDataFrame(made, "brand_id string, event_type string, currency_code string, signed_minor long, effective_at timestamp")
    got = {tuple(r) for r in composition(ledger, "2024-01-02").collect()}
    assert got == {("b", "finalization", "INR", 5), ("b", "refund", "INR", -2), ("b", "refund", "KWD", -1), ("b", "cancellation", "INR", 0), (None, "refund", "INR", 3)}
    assert composition(ledger.limit(0), "2024-01-02").collect() == []
