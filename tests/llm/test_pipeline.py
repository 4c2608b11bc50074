import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_each_stage_on_its_own_input(spark, sf, make, texts):
    """Stage by stage: what is kept is rows of the input, and decided as the operators' own tests hold against brute force."""
    from foliospark.llm import decontamination, quality_rules
    from test_jaccard_join import brute

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    by = dict(pipeline.STAGES)
    kept = by["quality_rules"](spark, documents, sf)
    judged = {r.doc_id for r in quality_rules.judge(documents).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == judged and kept.columns == documents.columns
    one = by["jaccard_join"](spark, kept, sf)
    left = {i: texts[i] for i in judged}
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in brute(left).items() if i == c)
    clean = by["decontamination"](spark, one, sf)
    leaked = {r.doc_id for r in decontamination.leaks(one, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaked
    mixed = by["source_mixing"](spark, clean, sf)
    assert mixed.columns == documents.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    final = by["sharding"](spark, mixed, sf)
    assert final.count() == mixed.count() and set(final.columns) == {*documents.columns, "shard", "slot"}


def test_odd_and_empty_tables(spark, sf, odd, none):
    for docs in (odd, none):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert set(docs.columns) <= set(out.columns), name
            assert docs is odd or out.count() == 0


def test_run(spark, sf):
    rows = pipeline.run(spark, sf).collect()
    assert rows and sorted({r.shard for r in rows}) == list(range(16))
