"""Stored watermarks and runs, hashes of many texts, and silver folds on rows that tie or lack fields."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from quern.functions.hashing import murmur3_32, murmur3_many
from quern.operators import jobs, silver, stitch
from quern.operators.tables import StoredTable

T0 = datetime(2024, 1, 1)


def test_runs_resume_at_the_stored_watermark(spark, tmp_path):
    marks, target = str(tmp_path / "marks"), str(tmp_path / "target")
    build = lambda df: df.select("k", "v", "ingested_at")
    source = lambda n: spark.createDataFrame([(i % 3, i, T0 + timedelta(hours=i)) for i in range(n)], "k int, v int, ingested_at timestamp")
    run = lambda n, **o: jobs.run_job(spark, "j", source(n), build, target, marks, ["k"], [F.desc("ingested_at")], **o)
    assert jobs.read_watermark(spark, marks, "j") is None
    assert run(4)["rows"] == 3 and jobs.read_watermark(spark, marks, "j") == T0 + timedelta(hours=3)
    second = run(7)
    assert second["from"] == str(T0 + timedelta(hours=3) - timedelta(seconds=600)) and run(7)["rows"] == 3
    rows = {r["k"]: r["v"] for r in StoredTable(spark, target, ["k"]).read().collect()}
    assert rows == {0: 6, 1: 4, 2: 5} and jobs.read_watermark(spark, marks, "other") is None
    run(7, full=True)
    assert {r["k"]: r["v"] for r in StoredTable(spark, target, ["k"]).read().collect()} == rows


def plain_murmur3(data: bytes, seed: int) -> int:
    m, h, whole = 0xFFFFFFFF, seed, len(data) // 4 * 4
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    for i in range(0, whole, 4):
        k = rot(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & m
    h ^= rot(int.from_bytes(data[whole:], "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & m
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_many_texts_hash_as_one_by_one():
    texts = ["é" * i + "abc"[: i % 4] for i in range(40)] + ["", "x" * 1000]
    assert murmur3_many(pa.array(texts), 7).tolist() == [plain_murmur3(t.encode(), 7) for t in texts] == [murmur3_32(t.encode(), 7) for t in texts]


def envelopes(spark, rows):
    full = [(b, i, T0 + timedelta(hours=h), T0, json.dumps({"properties": p}) if p is not None else "not json") for b, i, h, p in rows]
    return spark.createDataFrame(full, "brand_id string, event_id long, occurred_at timestamp, ingested_at timestamp, pj string")


def test_completed_returns_stay_completed(spark):
    rows = [("b", 1, 1, {"order_id": "o", "is_return_complete": "true", "status": "done"}), ("b", 2, 9, {"order_id": "o", "status": "open"}), ("b", 3, 1, {"order_id": ""}), ("b", 4, 1, None), ("b", 5, 2, {"order_id": 7, "status": "s"})]
    got = {r["order_id"]: (r["current_status"], r["is_return_complete"], r["return_class"]) for r in silver.return_states(envelopes(spark, rows)).collect()}
    assert got == {"o": ("done", True, "none"), "7": ("s", False, "none")}


def test_unreadable_amounts_are_nothing(spark):
    rows = [("b", 1, 1, {"amount_minor": "x", "fee_minor": 5, "settlement_at": "soon"}), ("b", 2, 1, None)]
    got = silver.settlements(envelopes(spark, rows)).orderBy("event_id").collect()
    assert [(r["amount_minor"], r["fee_minor"], r["currency_code"], r["settlement_at"]) for r in got] == [(0, 5, "INR", None), (0, 0, "INR", None)]


def test_a_winner_needs_one_profile(spark):
    lanes = [("s1", "email", "e"), ("s1", "anonymous_id", "a"), ("s2", "anonymous_id", "a"), ("s3", "email", "e"), ("s3", "phone", "p"), ("s4", "anonymous_id", "old")]
    df = spark.createDataFrame([("b", s, T0, lane, h, lane != "anonymous_id") for s, lane, h in lanes], "brand_id string, session_id string, session_start timestamp, lane string, identifier_hash string, is_strong boolean")
    known = [("e", 1, T0), ("a", 1, T0), ("p", 2, T0), ("old", 3, T0 - timedelta(days=91))]
    mapping = spark.createDataFrame([("b", *k) for k in known], "brand_id string, identifier_hash string, profile_id int, last_seen_at timestamp")
    assert {r["session_id"]: r["profile_id"] for r in silver.session_winners(df, mapping).collect()} == {"s1": 1, "s2": 1}


def test_stitches_need_one_identified_side_of_the_tenant(spark):
    schema = "brand_id string, visitor_id int, ua_class string, screen_class string, daypart int, active_hours array<int>, top_products array<string>, person string"
    like = ("u", "s", 1, [6, 7, 8], ["a", "b", "c"])
    rows = [("b", 1, *like, None), ("b", 2, *like, "P"), ("c", 3, *like, None), ("b", 4, *like, "O"), ("b", 5, "u", "x", 2, [13], ["z"], None), ("b", 6, *like, None)]
    got = {r["visitor_id"]: r["person"] for r in stitch.stitched(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "O", 6: "O"}
