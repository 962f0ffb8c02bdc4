"""The whole pipeline on odd rows, clashing columns and empty tables."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_corpus import ODD, prose


def put(spark, folder, docs, labels, bench) -> str:
    made = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as curve", "2 as Shard", "3 as size", "'x' as label")
    made.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_on_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    base = [" ".join(prose(rng, rng.randrange(20, 60))) for _ in range(40)]
    docs = [(i, t, None if i == 7 else "en", None if i == 5 else f"s{(i or 0) % 3}", len(t or "")) for i, t in ODD]
    docs += [(100 + i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    docs += [(200, base[0], "en", "s0", 3)] * 3 + [(300, "some words before " + base[1] + " and after", "en", "s1", 9)]
    out = corpus_pipeline.run(spark, put(spark, tmp_path, docs, [(100, 1, 0), (101, 1, 0), (None, 0, None)], [(1, base[1]), (2, None), (3, base[2])]))
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "curve", "Shard", "size", "label", "curve_", "shard_"]
    ids = {r["doc_id"] for r in rows}
    assert not ids & {101, 102, 300, 200} and len(ids) > 10  # items and copies go
    assert all(0 <= r["shard_"] < 24 for r in rows)


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, put(spark, tmp_path, [], [], [])).count() == 0
