from __future__ import annotations

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        assert docs.columns[: len(columns)] == columns and (k == 4 or docs.columns == columns)
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[5] == sizes[4] > 0
    assert docs.dropDuplicates(["text"]).count() == docs.dropDuplicates(["doc_id"]).count()
