"""Stored tables: whole or not at all, only touched buckets, and pre-aggregates kept up."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.operators import jobs
from quern.operators.metrics import CELL, Catalogue, Entity, Measure, Metric
from quern.operators.tables import StoredTable


def rows(spark, n, v=0):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") + v).alias("v"))


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_merges_rewrite_touched_buckets_only(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), ["k"], 8)
    assert table.read(rows(spark, 1).schema).count() == 0 and table.pointer() is None
    table.replace(rows(spark, 100), mark="1")
    before = table.pointer()["folders"]
    table.merge(rows(spark, 3, 1000), ["k"], [F.desc("v")], mark="2")
    after = table.pointer()["folders"]
    assert told(table.read()) == sorted((k, k + 1000 if k < 3 else k) for k in range(100))
    assert 0 < sum(before[b] != after[b] for b in before) <= 3 and table.facts() == {"mark": "2"}
    wide = rows(spark, 1, 5).withColumn("more", F.lit("x"))
    table.merge(wide, ["k"], [F.desc("v")])
    assert table.read().where("k = 0").first()["more"] == "x" and table.read().where("k > 0 and more is null").count() == 99
    table.swap(table.read().limit(0), table.read().where("k < 50").select("k"))
    assert table.read().count() == 50


@pytest.mark.parametrize("stage", ["data", "pointer"])
def test_a_write_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch, stage):
    table = StoredTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.replace(rows(spark, 20))
    bad = rows(spark, 20, 7)
    if stage == "data":
        bad = bad.withColumn("v", F.when(F.col("k") == 13, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("v")))
    else:
        monkeypatch.setattr(StoredTable, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        table.merge(bad, ["k"], [F.desc("v")])
    monkeypatch.undo()
    assert told(table.read()) == [(k, k) for k in range(20)]
    table.merge(rows(spark, 20, 7), ["k"], [F.desc("v")])  # the number is taken again
    assert told(table.read()) == [(k, k + 7) for k in range(20)] and table.pointer()["number"] == 2


def test_a_run_that_dies_halfway_is_repeated(spark, tmp_path, monkeypatch):
    t0 = datetime(2024, 1, 1)
    source = spark.createDataFrame([(i % 5, i, t0 + timedelta(hours=i)) for i in range(12)], "k int, v int, ingested_at timestamp")

    def run(folder, n):
        return jobs.run_job(spark, "j", source.where(f"v < {n}"), lambda df: df, f"{tmp_path}/{folder}", f"{tmp_path}/{folder}-marks", ["k"], [F.desc("ingested_at")])

    for n in (6, 12):
        run("calm", n)
    run("torn", 6)
    monkeypatch.setattr(StoredTable, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        run("torn", 12)
    monkeypatch.undo()
    read = lambda folder: told(StoredTable(spark, f"{tmp_path}/{folder}", ["k"]).read())
    assert len(read("torn")) == 5 and jobs.read_watermark(spark, f"{tmp_path}/torn-marks", "j") == t0 + timedelta(hours=5)
    run("torn", 12)
    assert read("torn") == read("calm")


def catalogue_of(df):
    measures = {"n": Measure("order"), "gross": Measure("order", "amount"), "late": Measure("order", "amount", "kind = 'x'")}
    metrics = {"aov": Metric("aov", ("gross", "n", "late"), "gross div n")}
    return Catalogue({"order": Entity(lambda: df, "at", "kind <> 'no'", key=("id",))}, measures, metrics)


def facts(spark):
    at = F.timestamp_seconds(F.col("id") * 200_000)
    kind = F.when(F.col("id") % 7 == 0, "no").when(F.col("id") % 2 == 0, "x").otherwise("y")
    return spark.range(400).select("id", F.concat(F.lit("b"), F.col("id") % 3).alias("brand_id"), F.lit("INR").alias("currency_code"), at.alias("at"), (F.col("id") * 3).alias("amount"), kind.alias("kind"))


def test_kept_up_equals_built_anew(spark, tmp_path):
    full = facts(spark)
    part = catalogue_of(full.where("id % 10 <> 0"))
    held = StoredTable(spark, str(tmp_path / "p"), CELL, 8)
    part.rebuild(held, "aov", "month", ("kind",))
    fresh = StoredTable(spark, str(tmp_path / "q"), CELL, 8)
    late = full.where("id % 10 = 0 and kind <> 'no'").withColumn("bucket", F.date_format(F.date_trunc("month", "at"), "yyyy-MM-dd"))
    catalogue_of(full).upkeep(held, late)
    catalogue_of(full).rebuild(fresh, "aov", "month", ("kind",))
    columns = held.read().columns
    assert told(held.read()) == told(fresh.read().select(*columns))
    gone = full.where("brand_id <> 'b1'")  # all rows of some cells disappear
    cells = full.where("brand_id = 'b1'").withColumn("bucket", F.date_format(F.date_trunc("month", "at"), "yyyy-MM-dd"))
    catalogue_of(gone).upkeep(held, cells)
    assert told(held.read().select("brand_id").distinct()) == [("b0",), ("b2",)]


def test_a_rebuild_that_dies_leaves_the_old_answer(spark, tmp_path):
    held = StoredTable(spark, str(tmp_path / "p"), CELL, 4)
    catalogue_of(facts(spark)).rebuild(held, "aov")
    before = told(held.read())
    bad = facts(spark).withColumn("amount", F.when(F.col("id") == 398, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("amount") + 1))
    with pytest.raises(Exception, match="lost"):
        catalogue_of(bad).rebuild(held, "aov")
    assert told(held.read()) == before


def test_lineage_rows_add_up_and_a_lost_row_shows(spark):
    c = catalogue_of(facts(spark))
    traced = c.lineage("aov")
    assert traced.where("measure = 'gross'").count() == facts(spark).where("kind <> 'no'").count()
    assert c.verified(traced, "aov").where("not agrees").count() == 0
    short = c.verified(traced.where("source_id <> '5'"), "aov").where("not agrees").collect()
    assert {r["measure"] for r in short} == {"n", "gross"}
    assert c.lineage("aov", brand="b1").select("brand_id").distinct().count() == 1
    c.entities["order"] = replace(c.entities["order"], key=())
    with pytest.raises(ValueError, match="traced"):
        c.lineage("aov")
