"""What near-dedup leaves on the way: frames held on executors' disks, near copies that meet once."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.llm import neardup
from quern.session import shelf


def test_a_shelf_holds_rows_until_its_end(spark):
    context = spark.sparkContext._jsc.sc()
    before = context.getPersistentRDDs().size()
    rows = spark.range(0, 25_000, 1, 7).select("id", F.concat(F.lit("x"), "id").alias("s"), F.array("id", F.lit(None)).alias("a"))
    with shelf() as keep:
        once = spark.sparkContext.accumulator(0)

        @F.udf("long")
        def counted(x):
            once.add(1)
            return x

        held = keep(rows.withColumn("id", counted("id")).groupBy("id", "s", "a").count())
        assert held.count() == 25_000
        assert held.join(rows, "id").where((rows["s"] == held["s"]) & (F.col("count") == 1)).count() == 25_000
        assert {(r["id"], r["s"], tuple(r["a"])) for r in held.collect()} == {(i, f"x{i}", (i, None)) for i in range(25_000)}
        assert once.value == 25_000
        assert context.getPersistentRDDs().size() == before + 1
    assert context.getPersistentRDDs().size() == before


def test_classes_store_few_frames_and_hold_none(spark, docs_of, monkeypatch):
    base = [f"w{i}" for i in range(40)]
    docs = docs_of([(i, " ".join([*base, *[f"own{i}x{j}" for j in range(i % 4)]])) for i in range(12)])
    frame, calls = type(docs), []
    checkpoint = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **b: calls.append(1) or checkpoint(self, *a, **b))
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    assert {r["class_id"] for r in neardup.classes(docs).collect()} == {0}
    assert len(calls) <= 8  # 14 and more when every frame on the way was stored
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held


def join_rows(node) -> list[int]:
    """Rows made by every join with a condition of its own, in the plan that ran."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return join_rows(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return join_rows(node.plan())
    own = [node.metrics().apply("numOutputRows").value()] if "Join" in kind and node.condition().isDefined() else []
    return own + [n for i in range(node.children().size()) for n in join_rows(node.children().apply(i))]


def test_near_copies_meet_once(spark):
    size = 40
    rows = [(t, t, 100, [*range(95), *(1000 + 10 * t + j for j in range(5))]) for t in range(size)]
    sets = spark.createDataFrame(rows, "t bigint, c bigint, n int, elements array<bigint>")
    met = neardup._met(neardup._entries(sets, 0.8).cache(), 0.8)
    pairs = {frozenset((r["x"], r["y"])) for r in met.collect()}
    assert pairs == {frozenset((x, y)) for x in range(size) for y in range(x)}
    assert sum(join_rows(met._jdf.queryExecution().executedPlan())) == len(pairs)  # 10 times as many when each first element counted
