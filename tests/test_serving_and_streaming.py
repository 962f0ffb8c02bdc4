from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern.plans.serving import for_brand, guard, safe, serve
from quern.sources.events import admit, or_empty
from quern.sources.vendors import canonical, cost_sheet
from quern.streaming.microbatch import Versions, read_folder, upsert_stream, windowed


@pytest.mark.parametrize("bad", ["", "drop table x", "select 1; select 2", "insert into t select 1", "with a as (select 1) delete from t", "/* select */ update t set a = 1"])
def test_guard_refuses(bad):
    with pytest.raises(ValueError):
        guard(bad)


@pytest.mark.parametrize("good", ["select 'drop table x; --' as a", "WITH a AS (SELECT 1) SELECT * FROM a;", "select 1 -- ; drop table x"])
def test_guard_lets_reads_pass(good):
    assert guard(good)


def test_serve_sees_one_tenant_only(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "brand_id string, n int")
    assert serve(spark, "select sum(n) as n from t", {"t": df}, "a") == [{"n": 1}]
    with pytest.raises(PermissionError):
        for_brand(df, None)


def test_safe_values():
    assert safe({"a": 2**60, "b": float("nan"), "c": [Decimal("1.50"), True, None], "d": datetime(2024, 1, 1)}) == {"a": str(2**60), "b": None, "c": ["1.50", True, None], "d": "2024-01-01T00:00:00"}


def test_admission_gate(spark):
    def event(i, name, **over):
        base = {"event_id": f'"{i}"', "brand_id": '"b"', "event_name": f'"{name}"', "occurred_at": '"2024-01-01T00:00:00Z"', "consent_flags": '{"analytics": "true"}', "properties": '{"install_token": "t"}'} | over
        return ("{" + ", ".join(f'"{k}": {v}' for k, v in base.items()) + "}",)

    rows = [
        event(1, "page.viewed"),
        event(2, "page.viewed", consent_flags="null"),
        event(3, "page.viewed", properties='{"install_token": "other"}'),
        event(4, "order.live.v1", consent_flags="null", properties="{}"),
        event(5, "identify", consent_flags='{"analytics": "false"}'),
        event(6, "identify", properties='{"install_token": "t", "consent_state": "denied"}'),
        event(7, "page.viewed", occurred_at='"not a time"'),
        ("not json",),
    ]
    tokens = spark.createDataFrame([("t", "b"), ("other", "c")], "install_token string, brand_id string")
    got = admit(spark.createDataFrame(rows, "payload string"), tokens, ("order.live.v1",)).collect()
    assert sorted((r["event_id"], r["lane"], r["category"]) for r in got) == [("1", "pixel", "behaviour"), ("4", "server", "transaction")]


def test_vendor_amounts_are_exact(spark):
    rows = [("b", '{"id": "9", "total": "0.29", "currency": "INR", "status": "paid", "billing": {"email": " A@B.co ", "phone": "98765 43210"}}'), ("b", '{"total": "5"}')]
    got = canonical(spark.createDataFrame(rows, "brand_id string, payload string"), "woocommerce_order").collect()
    assert len(got) == 1 and got[0]["amount_minor"] == 29 and len(got[0]["email_hash"]) == 64


def test_cost_sheet_rejects_with_reasons(spark):
    rows = [("s1", "1.5", "inr", "2024-01-01"), ("", "1", "INR", "2024-01-01"), ("s", "x", "INR", "2024-01-01"), ("s", "1", "ABC", "2024-01-01"), ("s", "1", "INR", "soon")]
    clean, bad = cost_sheet(spark.createDataFrame(rows, "sku string, cost string, currency string, valid_from string"))
    assert clean.first()["cost_minor"] == 150 and clean.count() == 1
    assert {r["reason"] for r in bad.collect()} == {"sku missing", "cost not a positive number", "currency unknown", "date not valid"}


def test_or_empty(spark, tmp_path):
    assert or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_upsert_stream_equals_batch(spark, tmp_path):
    schema = "k int, v int, at timestamp"
    t = datetime(2024, 1, 1)
    for i, rows in enumerate([[(1, 1, t), (2, 1, t)], [(2, 2, t + timedelta(hours=1)), (3, 1, t)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        table = Versions(spark, str(tmp_path / "table"), schema)
        upsert_stream(read_folder(spark, str(tmp_path / "in"), schema, 1), table, ["k"], [F.desc("at"), F.desc("v")], str(tmp_path / "state")).awaitTermination(120)
    assert sorted((r["k"], r["v"]) for r in table.current().collect()) == [(1, 1), (2, 2), (3, 1)]


def test_windows_of_a_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    spark.createDataFrame([("a", 5, t), ("a", 6, t + timedelta(minutes=5)), ("a", 1, t + timedelta(hours=3))], "k string, v int, at timestamp").write.parquet(str(tmp_path / "in"))
    out = windowed(read_folder(spark, str(tmp_path / "in"), "k string, v int, at timestamp"), ["k"], "at", "v")
    q = out.writeStream.format("memory").queryName("windows_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["n"], r["amount"]) for r in spark.table("windows_test").collect()) == [(1, 1), (2, 11)]
