"""The pipeline's stages one after another, and on odd rows."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_texts import SCHEMA, odd_rows


def test_stages_keep_their_contract(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        assert i == 4 or docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] > counts[3] > 0 and counts[4] > 0 and counts[5] == counts[4]
    assert docs.filter("ids IS NULL OR n_tokens <> size(ids)").count() == 0


def test_odd_and_empty_rows(spark):
    for rows in (odd_rows(), []):
        docs = spark.createDataFrame(rows, SCHEMA).withColumn("x.y", F.lit("z"))
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, "").count() >= 0
