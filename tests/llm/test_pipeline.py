"""The pipeline: each stage on what the one before it kept."""

import corpus_pipeline
import pytest
from oracle import SF
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize
from argusframe.llm import near_dedup


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_made", F.lit(1)).withColumn("node", F.lit(2))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, before, SF), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if "n_chars" in out.columns:
            assert out.where(F.col("text").isNotNull() & (F.col("n_chars") != F.length("text"))).isEmpty()
        assert out.join(before, "doc_id", "left_anti").isEmpty()
        if name == "near_dedup":
            assert near_dedup.group(out).where("NOT kept").isEmpty() and out.count() < before.count()
        if name == "pii":
            assert out.where("text LIKE '%[EMAIL]%'").count() > 0 and out.where("text RLIKE '[a-z]+\\\\.[0-9]+@mail'").isEmpty()
        before = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert pieces.select("doc_id").distinct().count() == before.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "pii", "packing"]


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_and_empty_tables(spark, odd, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, none, SF).count() == 0
    out = stage(spark, odd, SF)
    assert out.count() > 0 and (name == "packing" or out.columns == odd.columns)


def test_no_text_is_lost_where_texts_share_a_doc_id(spark, odd):
    """Of the near copies of two texts under one doc_id, one of each stays."""
    kept = [r.text for r in near_dedup.keep_one(odd).collect() if r.doc_id in (11, 12, 13, 14)]
    assert sorted(t.split()[0] for t in kept) == ["alpha0", "beta0"]


def test_nothing_is_left_behind(spark):
    """Once a scope closes, no intermediate table is."""
    import os

    from argusframe.checkpoints import scratch, shared_dir

    before = set(os.listdir(shared_dir(spark)))
    with scratch():
        corpus_pipeline.run(spark, SF).count()
    assert set(os.listdir(shared_dir(spark))) == before
