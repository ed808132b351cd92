"""The corpus pipeline, stage by stage."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF).persist()
        seen.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    missed = labels.filter("quality = 1").join(first, "doc_id", "left_anti").count()
    kept_bad = labels.filter("quality = 0").join(first, "doc_id", "left_semi").count()
    assert missed <= 0.1 * labels.count() and kept_bad <= 0.1 * labels.count()
    tokens = docs.agg(F.sum("length")).first()[0]
    assert seen[0] >= seen[1] >= seen[2] > 0 and tokens > 0
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == tokens
