"""The credit ledger: refolds, reruns and refunds, over journeys that change, against fresh folds."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quern.functions.scalars import deterministic_id
from quern.operators import attribution as A
from quern.operators import ledger as L
from quern.session import stored

KEYS = ["brand_id", "order_id"]


def fold(spark, journeys):
    """Credits of (amount, path) by journey."""
    rows = [("b", o, i + 1, c, amount) for o, (amount, path) in journeys.items() for i, c in enumerate(path)]
    df = spark.createDataFrame(rows, "brand_id string, order_id long, seq int, channel string, amount_minor long")
    out = A.credits(A.weights(df, KEYS, "seq", ("linear", "last_touch")), KEYS, "amount_minor", "seq")
    return stored(out.withColumn("credit_id", deterministic_id(F.col("order_id"), F.col("seq"), F.col("channel"), F.col("model"))).select(*KEYS, "model", "seq", "credit_id", "weight", "credit_minor"))


def sums(rows):
    out = {}
    for r in rows:
        out[r["order_id"], r["model"]] = out.get((r["order_id"], r["model"]), 0) + r["credit_minor"]
    return out


def test_refolds_leave_the_sums_of_a_fresh_fold_and_touch_nothing_else(spark):
    rng = random.Random(6)
    journeys = {o: (rng.randrange(1000), [rng.choice("abc") for _ in range(rng.randrange(1, 5))]) for o in range(30)}
    first = fold(spark, journeys)
    ledger = stored(L.refold(L.empty(first, KEYS, "seq"), first, KEYS, "seq"))
    old = {tuple(r) for r in ledger.collect()}
    assert len(old) == first.count() and sums(ledger.collect()) == sums(first.collect())
    for step in range(3):
        for o in rng.sample(range(30), 6):  # another amount, another path, and back again
            journeys[o] = (journeys[o][0] + 5, journeys[o][1]) if step == 0 else (journeys[o][0], journeys[o][1][::-1] + ["z"] * (step % 2))
        now = fold(spark, {o: j for o, j in journeys.items() if o != 3})
        more = stored(L.refold(ledger, now, KEYS, "seq"))
        before = sums(ledger.where("order_id <> 3").collect())
        assert {r["order_id"] for r in more.collect()} <= set(range(30)) - {3}
        ledger = stored(ledger.unionByName(more).repartition(3))
        want = sums(now.collect())
        assert sums(ledger.where("order_id <> 3").collect()) == want
        changed = {k[0] for k in want if want[k] != before[k]}
        assert changed <= {r["order_id"] for r in more.collect()}
        assert L.refold(ledger, now, KEYS, "seq").count() == 0
        assert old <= {tuple(r) for r in ledger.collect()}
        assert ledger.select("row_id").distinct().count() == ledger.count()


def test_a_credit_that_comes_back_is_written_again(spark):
    a, b = fold(spark, {1: (100, ["x", "y"])}), fold(spark, {1: (100, ["y", "x"])})
    ledger = stored(L.refold(L.empty(a, KEYS, "seq"), a, KEYS, "seq"))
    for now in (b, a, b):
        ledger = stored(ledger.unionByName(L.refold(ledger, now, KEYS, "seq")))
    got = L.standing(ledger, KEYS, "seq").where("live").select("credit_id").collect()
    assert {r[0] for r in got} == {r["credit_id"] for r in b.collect()}
    assert max(r["occurrence"] for r in ledger.collect()) == 2 and sums(ledger.collect()) == {(1, "linear"): 100, (1, "last_touch"): 100}


def test_refunds_take_back_what_was_credited_at_most_and_once(spark):
    rows = fold(spark, {1: (100, ["x", "y", "z"]), 2: (50, ["x"])})
    ledger = stored(L.refold(L.empty(rows, KEYS, "seq"), rows, KEYS, "seq"))
    refunds = lambda *r: spark.createDataFrame([("b", *x) for x in r], "brand_id string, order_id long, refund_id string, refund_minor long")
    for batch in (refunds((1, "r1", 30)), refunds((1, "r1", 30), (1, "r2", 50), (1, "r3", 40)), refunds((1, "r4", 10), (2, "r5", 20))):
        ledger = stored(ledger.unionByName(L.claw_back(ledger, batch, KEYS, "seq")))
        assert L.claw_back(ledger, batch, KEYS, "seq").count() == 0
    assert sums(ledger.collect()) == {(1, "linear"): 0, (1, "last_touch"): 0, (2, "linear"): 30, (2, "last_touch"): 30}
    each = {(r["order_id"], r["refund_id"], r["model"]): r["s"] for r in ledger.where("row_kind = 'clawback'").groupBy("order_id", "refund_id", "model").agg(F.sum("credit_minor").alias("s")).collect()}
    assert [each[1, f"r{i}", "linear"] for i in (1, 2, 3, 4)] == [-30, -50, -20, 0]
    assert L.refold(ledger, fold(spark, {1: (90, ["x", "y", "z"])}), KEYS, "seq").where("model = 'linear'").count() == 0  # a clawed credit stands
