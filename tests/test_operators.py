from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import attribution as A
from quern.operators import economics as E
from quern.operators import identity as I
from quern.operators import maintenance as X
from quern.operators import marts as M
from quern.operators import sessions as S
from quern.operators import upsert as U

T0 = datetime(2024, 1, 1)


def test_sessions_split_only_beyond_the_gap(spark):
    at = [0, 1799, 1799 + 1800, 1799 + 1800 + 1801]
    df = spark.createDataFrame([(1, i, T0 + timedelta(seconds=s)) for i, s in enumerate(at)], "v int, id int, at timestamp")
    got = [r["session_seq"] for r in S.sessionize(df, ["v"], "at", "id").orderBy("id").collect()]
    assert got == [1, 1, 1, 2]


def test_near_in_time_meets_bucket_edges(spark):
    left = spark.createDataFrame([(1, T0 + timedelta(seconds=59)), (1, T0 + timedelta(hours=5))], "k int, at timestamp")
    right = spark.createDataFrame([(1, T0 + timedelta(seconds=s), s) for s in (0, 119, 120)], "k int, t timestamp, s int")
    rows = S.near_in_time(left, right, ["k"], "at", "t", 60).collect()
    assert sorted((r["s"] is None, r["s"]) for r in rows) == [(False, 0), (False, 119), (True, None)]


def test_collapse_and_edges(spark):
    df = spark.createDataFrame([(["a", "a", "b", "a"],), (["x"],)], "p array<string>")
    rows = df.select(S.collapse(F.col("p")).alias("p")).withColumn("e", S.edges(F.col("p"))).collect()
    assert rows[0]["p"] == ["a", "b", "a"] and [(e["step"], e["from_channel"], e["to_channel"]) for e in rows[0]["e"]] == [(1, "a", "b"), (2, "b", "a")]
    assert rows[1]["e"] == []


@settings(max_examples=6, deadline=None, derandomize=True, database=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(10**15), 10**15), st.lists(st.integers(0, 10**12), min_size=1, max_size=6)), min_size=1, max_size=6))
def test_apportion_adds_up_and_keeps_the_sign(spark, groups):
    rows = [(g, total, i, w) for g, (total, ws) in enumerate(groups) for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "g int, total long, i int, w long")
    for split in (E.apportion, E.apportion_to_top):
        out = split(df, ["g"], "total", "w", [F.col("i")], "part").collect()
        for g, (total, _) in enumerate(groups):
            assert sum(r["part"] for r in out if r["g"] == g) == total
    out = E.apportion(df, ["g"], "total", "w", [F.col("i")], "part").collect()
    assert all(r["part"] * r["total"] >= 0 for r in out)


def test_apportion_beyond_64_bits_and_without_weight(spark):
    df = spark.createDataFrame([(1, 9 * 10**17, 0, 10**12), (1, 9 * 10**17, 1, 2 * 10**12), (2, 7, 0, 0), (2, 7, 1, 0)], "g int, total long, i int, w long")
    got = {(r["g"], r["i"]): r["part"] for r in E.apportion(df, ["g"], "total", "w", [F.col("i")], "part").collect()}
    assert got == {(1, 0): 3 * 10**17, (1, 1): 6 * 10**17, (2, 0): 7, (2, 1): 0}


def test_dated_lookup_is_half_open(spark):
    rows = spark.createDataFrame([("a", T0), ("a", T0 + timedelta(days=1)), ("b", T0)], "k string, at timestamp")
    bands = spark.createDataFrame([("a", T0, T0 + timedelta(days=1), 1), ("a", T0 + timedelta(days=1), None, 2)], "k string, valid_from timestamp, valid_to timestamp, c int")
    got = sorted((r["k"], r["at"], r["c"]) for r in E.dated_lookup(rows, bands, ["k"], "at").collect())
    assert [c for *_, c in got] == [1, 2, None]


def test_weights_by_model(spark):
    rows = [(1, i) for i in (1, 2, 3, 4)] + [(2, 1)] + [(3, 1), (3, 2)] + [(4, i) for i in range(100)]
    df = spark.createDataFrame(rows, "j int, seq int")
    got = {}
    for r in A.weights(df, ["j"], "seq").orderBy("seq").collect():
        got.setdefault((r["j"], r["model"]), []).append(r["weight"])
    assert got[1, "position_based"] == [40_000_000, 10_000_000, 10_000_000, 40_000_000]
    assert got[2, "linear"] == [100_000_000] and got[1, "last_touch"] == [0, 0, 0, 100_000_000]
    assert got[3, "position_based"] == [50_000_000, 50_000_000] and got[3, "time_decay"] == [33_333_333, 66_666_667]
    assert got[1, "time_decay"] == [6_666_667, 13_333_333, 26_666_667, 53_333_333]  # ages 3, 2, 1, 0 in touches: 1, 2, 4, 8 of 15
    assert got[4, "time_decay"][-3:] == [12_500_000, 25_000_000, 50_000_000]
    assert all(sum(w) == A.ONE for w in got.values())


def test_credits_then_full_clawback_cancel_out(spark):
    df = spark.createDataFrame([(1, i, 0, 101) for i in (1, 2, 3)], "j int, seq int, age int, amount long")
    credit = A.credits(A.weights(df, ["j"], "seq"), ["j"], "amount", "seq")
    back = A.clawbacks(credit, spark.createDataFrame([(1, 10**6)], "j int, refund_minor long"), ["j"], "seq")
    total = credit.select("j", "seq", "model", "credit_minor").union(back.select("j", "seq", "model", "credit_minor")).groupBy("model", "seq").agg(F.sum("credit_minor").alias("s"))
    assert {r["s"] for r in total.collect()} == {0}


def test_removal_effect_of_a_needed_channel(spark):
    paths = spark.createDataFrame([("b", ["x", "y"], True), ("b", ["x"], False), ("b", ["y"], True)], "b string, p array<string>, c boolean")
    rows = {r["channel"]: r for r in A.removal_effects(A.transitions(paths, ["b"], "p", "c"), ["b"]).collect()}
    assert rows["y"]["removal_effect"] == 1.0 and sum(r["weight"] for r in rows.values()) == A.ONE


def test_components_of_chain_and_ring(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(101, 102), (102, 103), (103, 101)]
    got = {r["node"]: r["component"] for r in I.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in (101, 102, 103)} == {101}


def test_canonical_follows_chains_and_ends_on_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "node string, target string")
    assert {r["node"]: r["canonical"] for r in I.canonical(links).collect()} == {"a": "c", "b": "c", "x": "x", "y": "x"}


def test_canonical_of_long_chains_and_tails_of_cycles(spark):
    rows = [(i, i + 1) for i in range(1000)] + [(5000 + i, 5000 + (i + 1) % 300) for i in range(300)] + [(6000 + i, 6001 + i) for i in range(20)] + [(6020, 5000)]
    got = {r["node"]: r["canonical"] for r in I.canonical(spark.createDataFrame(rows, "node int, target int")).collect()}
    assert all(got[i] == 1000 for i in range(1000)) and all(got[5000 + i] == 5000 for i in range(300)) and got[6000] == 5000


def test_resolver_never_guesses(spark):
    links = spark.createDataFrame([("email", "e1", "p"), ("phone", "f1", "p"), ("phone", "f2", "q")], "identifier_type string, identifier_hash string, profile_id string")
    lanes = spark.createDataFrame([(1, "email", "e1"), (1, "phone", "f1"), (2, "email", "e1"), (2, "phone", "f2"), (3, "email", "zz")], "o int, identifier_type string, identifier_hash string")
    got = {r["o"]: (r["profile_id"], r["candidates"]) for r in I.resolve_unique(lanes, links, ["o"]).collect()}
    assert got == {1: ("p", 1), 2: (None, 2), 3: (None, 0)}


def test_merge_is_idempotent_and_incremental_equals_full(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    once = U.merge_on_key(old, new, ["k"], [F.desc("n")])
    twice = U.merge_on_key(once, new, ["k"], [F.desc("n")])
    want = [(1, "a"), (2, "d"), (3, "e")]
    assert sorted((r["k"], r["v"]) for r in once.collect()) == want == sorted((r["k"], r["v"]) for r in twice.collect())
    empty = new.limit(0)
    assert U.merge_on_key(old, empty, ["k"], [F.desc("n")], shed=True).count() == 2
    figures = U.parity(once, twice, ["k"]).first()
    assert (figures["only_left"], figures["only_right"], figures["different"], figures["equal"]) == (0, 0, 0, 3)


@pytest.mark.parametrize(
    ("mark", "top", "kw", "want"),
    [
        (None, T0, {}, (None, None)),
        (T0, T0 + timedelta(hours=1), {"full": True}, (None, None)),
        (T0, T0 + timedelta(hours=1), {}, (T0 - timedelta(seconds=600), T0 + timedelta(hours=1))),
        (T0, T0 + timedelta(hours=9), {"slice_s": 3600}, (T0 - timedelta(seconds=600), T0 + timedelta(hours=1))),
        (T0, T0 - timedelta(hours=1), {}, (T0 - timedelta(seconds=600), T0)),
    ],
)
def test_incremental_window(mark, top, kw, want):
    assert U.incremental_window(mark, top, **kw) == want


def test_histogram_fills_empty_buckets(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("a", None)], "k string, v int")
    got = [(r["bucket"], r["n"]) for r in M.histogram(df, ["k"], "v", [("low", 2), ("mid", 5), ("high", None)]).orderBy("bucket_order").collect()]
    assert got == [("low", 1), ("mid", 0), ("high", 1)]


def test_mode_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("a", "")], "k string, v string")
    assert M.mode(df, ["k"], "v", "m").first()["m"] == "x"


def test_tiers_skip_after_a_failure():
    done = X.run_tiers({"a": (set(), lambda: 3), "b": ({"a"}, lambda: 1 // 0), "c": ({"b"}, lambda: 1), "d": ({"a"}, lambda: 2)})
    assert done["a"] == 3 and done["d"] == 2 and done["c"] == "skipped" and str(done["b"]).startswith("failed")


def test_dedup_log_keeps_rows_without_key(spark):
    log = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), (None, 1, "x"), (None, 2, "y")], "id string, offset int, v string")
    assert sorted(r["v"] for r in X.dedup_log(log, ["id"], ["offset"]).collect()) == ["new", "x", "y"]


def test_evolve_adds_columns(spark):
    stored, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, 5)], "k int, w int")
    assert U.evolve(new, stored).columns == ["k", "v", "w"] and U.evolve(new, stored).first()["v"] is None
