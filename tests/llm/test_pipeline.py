"""The pipeline's stages on their own, and end to end on the smallest tables."""

import os
import random

import pytest

pytest.importorskip("rillflow.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert 0 < after.count() <= before.count()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, DATA)
    assert packed.select("doc_id").distinct().count() == before.count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_language_drops_foreign_text_and_junk(spark):
    rng = random.Random(3)
    odd = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 5,
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心。" * 5,
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια. " * 5,
        "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق. " * 5,
        " ".join("%032x" % rng.getrandbits(128) for _ in range(10)),
        "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=400)),
        "123 ?!",
    ]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    kept = corpus_pipeline.language(spark, docs.unionByName(extra, allowMissingColumns=True), "")
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert min(ids) >= 0
    assert len(ids) >= 0.99 * docs.where("lang is not null").count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_take_odd_rows_and_clashing_names(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None), (None, ""), (7, "x " * 50_000), (7, "x " * 50_000), (None, "The same words in one text of no id."), (None, "The same words in one text of no id.")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).selectExpr("*", "1 AS score", "'a' AS lang_pred", "2 AS k1", "3 AS node", "4 AS spans", "5 AS item_id", "6 AS distance")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.columns == docs.columns and kept.where("score <> 1 or lang_pred <> 'a'").count() == 0, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).where("doc_id is null").count() >= 4
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "packing"]
