"""The stages over a small input: whole columns, decisions that take effect."""

import corpus_pipeline
from tidemark.llm import decontam, near_dedup, quality

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        if name != "token_files":
            assert after.columns == docs.columns
        from tidemark.llm.common import stored

        after = stored(after, name)
        rows[name] = (before, after)
        before = after
    a, b = rows["quality_classifier"]
    model = quality.fit(a, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in quality.score(a, model).where("predicted = 1").collect()}
    a, b = rows["minhash_near_dedup"]
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in near_dedup.near_duplicates(a).where("kept").collect()}
    a, b = rows["benchmark_decontamination"]
    found = decontam.search(decontam.build_index(a), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in found.where("not contaminated").collect()}
    a, b = rows["source_mixing"]
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in b.collect()} and b.count() >= a.count()
    a, b = rows["token_files"]
    assert sorted(r.doc_id for r in a.collect()) == sorted(r.doc_id for r in b.collect())
