"""Vendors' webhook lanes on odd payloads, each against what it must say."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.operators import silver as V
from quern.sources import lanes as L

AT = "2024-01-02T03:04:05Z"


def raw(spark, *rows, **more):
    """Rows of (label, payload): dicts become JSON, texts stay as they are."""
    made = [("b", label, label, label, p if isinstance(p, str) or p is None else json.dumps(p)) for label, p in rows]
    df = spark.createDataFrame(made, "brand_id string, event string, kind string, webhook_id string, payload string")
    return df.select("*", *[F.lit(v).alias(k) for k, v in more.items()])


def told(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def shaped(text):
    h = bytearray(hashlib.sha256(text.encode()).digest()[:16])
    h[6], h[8] = h[6] & 15 | 80, h[8] & 63 | 128
    x = h.hex()
    return "-".join((x[:8], x[8:12], x[12:16], x[16:20], x[20:]))


@pytest.mark.parametrize("text, want", [("12", 1200), (" 12.5 ", 1250), ("0.05", 5), ("1.234", None), ("-1", None), ("1e3", None), ("", None), (None, None), ("9" * 30, None), ("١", None)])
def test_amounts_are_exact_or_null(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(L.exact_minor(F.col("t"))).collect()[0][0] == want


@pytest.mark.parametrize("text, want", [("12", 12), ("-3", None), ("1.0", None), ("9" * 19, None), (None, None)])
def test_whole_amounts(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(L.whole_minor(F.col("t"))).collect()[0][0] == want


def test_gateway_lane(spark):
    good = {"id": " Rfnd_1 ", "payment_id": "pay_9", "amount": 500, "created_at": 1700000000, "processed_at": "2023-11-15T00:00:00Z", "currency": "usd"}
    rows = raw(
        spark, ("refund.processed", good), ("payment.dispute.closed", good), ("dispute.lost", good), ("payment.failed", good | {"fee": "x", "tax": -3, "order_id": "o1"}), ("order.paid", {"id": "order_1", "created_at": AT}),
        ("refund.failed", good | {"id": None}), ("order.paid", good | {"amount": "5.5"}), ("payment.captured", good | {"created_at": None}), ("payment.captured", "not json"), ("payment.captured", None), ("payment.captured", "[1]"), ("x.y", good), (None, good), salt=1,
    )
    out = L.payment_webhooks(rows, "ab").collect()
    assert [r.reject_reason for r in out] == [None] * 5 + ["id missing", "amount not whole", "time missing"] + ["payload isn't an object"] * 3 + ["event not known"] * 2
    secret = lambda v: hashlib.sha256(bytes.fromhex("ab") + v.encode()).hexdigest()
    assert out[0].refund_id_hash == secret("rfnd_1") and out[0].payment_id_hash == secret("pay_9") and out[0].occurred_at == datetime(2023, 11, 15) and out[0].currency_code == "USD"
    assert (out[1].dispute_lifecycle, out[1].dispute_direction, out[2].dispute_direction) == ("dispute.closed", "credit", "debit") and out[1].occurred_at == datetime(2023, 11, 14, 22, 13, 20)
    assert (out[3].fee_minor, out[3].tax_minor, out[3].order_id, out[3].payment_id_hash) == (None, -3, "o1", secret("rfnd_1"))
    assert (out[4].amount_minor, out[4].order_id, out[4].payment_id_hash, out[4].currency_code) == (0, "order_1", None, "INR")
    assert out[0].event_id == shaped("b:refund.processed:refund:settlement.webhook.v1")


def test_checkouts(spark):
    base = {"cart_id": 7, "updated_at": AT}
    rows = raw(spark, ("step", base | {"step": "pay", "total": "1.5"}), ("started", base | {"step": "pay", "address": {"a": 1}, "total": "1.505"}), ("abandoned", base | {"has_address": True}), ("completed", base), ("step", {"cart_id": " ", "updated_at": AT}), ("step", {"cart_id": "x", "updated_at": "soon"}))
    out = L.checkouts(rows, "gokwik").collect()
    assert [r.reject_reason for r in out] == [None, None, None, "kind not known", "checkout id missing", "time missing"]
    assert [(r.event_name, r.step_name, r.total_price_minor, r.has_address, r.order_id) for r in out[:3]] == [("gokwik.checkout_step.v1", "pay", 150, False, "7"), ("gokwik.checkout_started.v1", None, None, False, "7"), ("checkout.abandoned.v1", None, None, True, "7")]
    assert out[0].event_id == shaped("b:7:1704164645000:gokwik.checkout_step.v1")
    assert told(L.checkouts(rows, "shopflo"), "event_name")[3] == ("shopflo.checkout_completed.v1",)


def test_payments_without_an_id_differ_by_state(spark):
    base = {"order_id": "o", "created_at": AT, "amount": "2"}
    rows = raw(spark, ("attempted", base), ("attempted", base | {"status": "declined"}), ("attempted", base), ("authorized", base | {"payment_id": "P"}), ("attempted", {"created_at": AT}))
    out = L.payments(rows, "shopflo", "ab").collect()
    assert [r.payment_status for r in out[:4]] == ["initiated", "failed", "initiated", "authorized"] and out[0].event_id == out[2].event_id != out[1].event_id
    assert out[4].reject_reason == "order id missing" and told(L.payments(rows, "gokwik", "ab"), "payment_status")[1] == ("initiated",)


def test_risk_predictions_need_a_request_or_a_time(spark):
    rows = raw(spark, ("", {"order_id": "o", "request_id": "r", "risk_flag": "Medium-High"}), ("", {"order_id": "o", "occurred_at": AT}), ("", {"order_id": "o"}), ("", {"request_id": "r"}))
    assert told(L.risk_predictions(rows), "risk_flag", "reject_reason") == [("high", None), ("unknown", None), ("unknown", "neither request nor time"), ("unknown", "order id missing")]


@pytest.mark.parametrize("status, want", [("RETURN.Delivered", "return_delivered"), ("delivered", "return_delivered"), ("return__closed", "return_completed"), ("QC-Pending", "return_initiated"), ("returned", "none"), ("", "none"), (None, "none")])
def test_return_ladder(spark, status, want):
    rows = raw(spark, ("", {"order_id": 1, "status": status, "status_changed_at": AT}))
    assert told(L.return_states(rows), "return_class", "reject_reason") == [(want, None)]


def test_exceptions(spark):
    df = spark.createDataFrame([("Delayed",), ("NDR",), ("Address_Issue",), ("rto",), (None,)], "s string")
    assert told(df.select(L.exception_class(F.col("s")).alias("c")), "c") == [("delayed",), ("ndr",), ("ndr",), (None,), (None,)]


def test_storefront_depth(spark):
    order = {
        "id": 5, "current_total_price": "10.00", "currency": "INR", "updated_at": AT, "payment_gateway_names": ["Cash on Delivery (COD)"], "line_items": [{"price": "2.50", "quantity": 3, "total_discount": "0.5", "name": "n"}, {"price": "x", "quantity": 1}, {"price": "1", "quantity": -2}],
        "shipping_lines": [{"price": "bad"}], "refunds": [{"id": 1, "transactions": [{"kind": "refund", "amount": "1"}, {"kind": "void", "amount": "9"}, {"kind": "sale", "status": "failure", "amount": "9"}]}, {"id": 2}], "note_attributes": [{"name": "visitor_id", "value": "v1"}, {"name": "ttclid", "value": "t"}],
    }
    bare = {"id": 6, "current_total_price": "1", "updated_at": AT, "financial_status": "paid", "line_items": []}
    out = L.storefront_orders(raw(spark, ("", order), ("", bare), ("", "{"), ("", None), ("", bare | {"current_total_price": "1.999"}))).collect()
    a, b = out[:2]
    assert [(x.title, x.quantity, x.line_total_minor) for x in a.line_items] == [("n", 3, 700), (None, 0, 0)] and a.payment_method == "cod"
    assert (a.shipping_total_minor, a.refund_total_minor, [x.amount_minor for x in a.refunds], a.stitched_visitor_id, a.click_id) == (None, 100, [100, 0], "v1", "t")
    assert (b.line_items, b.refunds, b.refund_total_minor, b.stitched_visitor_id, b.payment_method) == (None, None, None, None, "prepaid")
    assert [r.reject_reason for r in out[2:]] == ["order id missing", "payload isn't an object", "amount not exact"]


def test_payments_take_the_latest_version_and_need_money(spark):
    schema = "brand_id string, event_id string, source string, payment_status string, order_id string, payment_id_hash string, amount_minor long, currency_code string, occurred_at timestamp"
    row = lambda i, amount, day, status="failed": ("b", i, "gokwik", status, "o", None, amount, "INR", datetime(2024, 1, day))
    hooks = spark.createDataFrame([row("x", 5, 1), row("x", 5, 2, "authorized"), row("y", 0, 1), row("z", None, 1), row(None, 5, 1), row("t", 5, 1, "a"), row("t", 5, 1, "b")], schema)
    none = hooks.limit(0)
    pixel = spark.createDataFrame([("b", "p", "payment.odd", "o", None, None, datetime(2024, 1, 1))], "brand_id string, event_id string, event_type string, order_id string, amount_minor long, currency_code string, occurred_at timestamp")
    connector = none.drop("payment_status").withColumn("entity_type", F.lit("order_paid"))
    want = {("x", "authorized"), ("p", "unknown"), ("t", "b")}
    assert set(told(V.payments(pixel, connector, hooks), "event_id", "payment_status")) == want == set(told(V.payments(pixel, connector, hooks.repartition(5, "payment_status")), "event_id", "payment_status"))


def test_empty_logs(spark):
    none = raw(spark, ("", None)).limit(0)
    for df in (L.payment_webhooks(none), L.checkouts(none, "gokwik"), L.payments(none, "shopflo"), L.refunds(none), L.risk_predictions(none), L.return_states(none), L.storefront_orders(none)):
        assert df.collect() == [] and L.accepted(df).columns == [c for c in df.columns if c != "reject_reason"]


def test_filters_do_not_repeat_the_parse(spark):
    plan = L.accepted(L.payments(raw(spark, ("attempted", {"order_id": "o", "created_at": AT})), "gokwik"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
