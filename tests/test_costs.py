"""Cost sheets day by day against a plain reading of their uploads, refusals, and decay weights by big integers."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quern.operators import attribution as A
from quern.operators import costs as C
from quern.operators.upsert import as_of

SHEET = "sku string, valid_from date, valid_to date, cost_minor long, upload int"
D0 = date(2024, 1, 1)


def day(n):
    return None if n is None else D0 + timedelta(days=n)


def test_corrections_hold_day_by_day(spark):
    rng = random.Random(3)
    uploads = []
    for number in range(5):
        rows = []
        for sku in "abcd":
            for _ in range(rng.randrange(3)):
                start = rng.randrange(20)
                rows.append((sku, start, rng.choice([None, start + rng.randrange(0, 9)]), rng.randrange(100), number))
        uploads.append(rows)
    frame = lambda rows: spark.createDataFrame([(s, day(f), day(t), c, n) for s, f, t, c, n in rows], SHEET)
    sheet = frame([])
    for rows in uploads:
        sheet = C.correct(sheet, frame(rows), ["sku"]).cache()
    bands = sheet.collect()
    for sku in "abcd":
        for n in range(35):
            held = [(u, f, c) for rows in uploads for s, f, t, c, u in rows if s == sku and f <= n and (t is None or n < t)]
            got = [r for r in bands if r["sku"] == sku and r["valid_from"] <= day(n) and (r["valid_to"] is None or day(n) < r["valid_to"])]
            assert [(r["cost_minor"], r["upload"]) for r in got] == ([(max(held)[2], max(held)[0])] if held else [])
    for r in bands:  # reads at a band's first day, its last and the day after
        ends = [r["valid_from"]] if r["valid_to"] is None else [r["valid_from"], r["valid_to"] - timedelta(days=1)]
        for at in ends:
            assert as_of(sheet.where(F.col("sku") == r["sku"]), F.lit(at)).first()["cost_minor"] == r["cost_minor"] if at in (bands[0]["valid_from"], bands[-1]["valid_from"]) else True
    again = C.correct(sheet, frame(uploads[-1]), ["sku"])
    assert sorted(map(str, again.collect())) == sorted(map(str, bands))


def test_overlaps_are_refused_and_known_starts_restated(spark):
    sheet = spark.createDataFrame([("a", day(0), day(10), 5, 1), ("a", day(20), None, 6, 1), ("b", day(0), None, 7, 1)], SHEET)
    rows = [("a", 0, 8, 50, 2), ("a", 12, 20, 51, 2), ("a", 15, 25, 52, 2), ("a", 5, 9, 53, 2), ("b", 3, 3, 54, 2), ("c", 1, 5, 55, 2), ("c", 1, 5, 55, 2), ("c", 4, None, 56, 2)]
    kept, refused = C.refuse_overlaps(sheet, spark.createDataFrame([(s, day(f), day(t), c, n) for s, f, t, c, n in rows], SHEET), ["sku"])
    assert sorted((r["sku"], r["cost_minor"]) for r in kept.collect()) == [("a", 6), ("a", 50), ("a", 51), ("b", 7), ("c", 55)]
    assert {(r["cost_minor"], r["reason"]) for r in refused.collect()} == {
        (52, "overlaps a row of this upload"), (53, "overlaps a row of this upload"), (54, "ends before it starts"), (55, "given twice"), (56, "overlaps a row of this upload")}
    alone = spark.createDataFrame([("a", day(3), day(30), 9, 2)], SHEET)
    assert C.refuse_overlaps(sheet, alone, ["sku"])[1].first()["reason"] == "overlaps a stored band"


def reckoned(n, half_life):
    """Decay weights in big integers: powers of the root of a half in 18 places, largest remainders."""
    one, units = 10**18, 10**8
    low, high = 0, one
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if 2 * middle**half_life <= one**half_life else (low, middle - 1)
    raw = [low ** (n - 1 - i) * one**i for i in range(n)]
    parts, rests = [units * x // sum(raw) for x in raw], [units * x % sum(raw) for x in raw]
    for i in sorted(range(n), key=lambda i: (-rests[i], 0 if i == 0 else 1 if i == n - 1 else i + 1))[: units - sum(parts)]:
        parts[i] += 1
    return parts


@pytest.mark.parametrize("half_life", [1, 2, 7, 14])
def test_decay_weights_equal_big_integers(spark, half_life):
    sizes = (2, 3, 61, 200)
    touches = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "journey int, seq int")
    got = {}
    for r in A.weights(touches, ["journey"], "seq", ("time_decay",), half_life).orderBy("journey", "seq").collect():
        got.setdefault(r["journey"], []).append(r["weight"])
    assert got == {n: reckoned(n, half_life) for n in sizes}
