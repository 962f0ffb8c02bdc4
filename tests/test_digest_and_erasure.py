"""Ordered digests against one string, and erasure by payload path."""

from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import functions as F

from quern.operators import maintenance as X
from quern.operators import upsert as U
from quern.operators.tables import StoredTable


def tree(lines, fan):
    while True:
        lines = [hashlib.md5("\n".join(lines[i : i + fan]).encode()).hexdigest() for i in range(0, len(lines), fan)]
        if len(lines) < 2:
            return lines[0] if lines else None


def test_digests_follow_order_and_content(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["x", "y", None]), rng.randrange(9)) for i in rng.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "k long, t string, n int")
    lines = ["|".join(str(x) for x in r if x is not None) for r in sorted(rows, key=lambda r: r[0])]
    for fan in (4096, 300, 7):
        assert U.ordered_digest(df.repartition(5), ["k"], ["k", "t", "n"], fan) == tree(lines, fan)
    assert U.ordered_digest(df, ["k"], ["k", "t", "n"]) == hashlib.md5("\n".join(lines).encode()).hexdigest()
    assert U.ordered_digest(df.limit(0), ["k"], ["k"]) is None
    swapped = df.withColumn("n", F.when(F.col("k") == rows[0][0], F.col("n") + 1).otherwise(F.col("n")))
    got = U.ordered_parity(df, swapped, ["k"], 16).first()
    assert not got["same_order"] and got["different"] == 1
    assert U.ordered_parity(df.where("k % 2 = 0"), df.where("k % 3 = 0"), ["k"], 16).first()["same_order"]


def test_erasure_meets_every_path_of_its_tenant_and_no_other_bucket(spark, tmp_path):
    told = lambda brand, **p: json.dumps({"brand_id": brand, "user": p.pop("user", None), "properties": p})
    payloads = [
        told("b", user="h1"), told("b", email="h1"), told("b", anon="a1"), told("c", user="h1"), told("b", email="a1"), told("b", user="h2"), "not json", None, told("b", user=1), told(None, user="h1"),
    ]
    log = spark.createDataFrame(list(enumerate(payloads)), "offset long, payload string")
    table = StoredTable(spark, str(tmp_path / "log"), ["offset"], 16)
    table.replace(log)
    before = table.pointer()
    subjects = spark.createDataFrame([("b", "hash", "h1"), ("b", "anon", "a1"), ("b", "hash", "h1")], "brand_id string, kind string, value string")
    paths = {"hash": ["user", "properties.email"], "anon": ["properties.anon"]}
    assert X.erase_payloads(table, subjects, "brand_id", paths) == 3
    assert {r["offset"] for r in table.read().collect()} == set(range(3, 10))
    after = table.pointer()
    assert 0 < sum(f != after["folders"].get(b) for b, f in before["folders"].items()) <= 3
    assert X.erase_payloads(table, subjects, "brand_id", paths) == 0 and table.pointer() == after
