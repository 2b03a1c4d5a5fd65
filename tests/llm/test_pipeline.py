"""The stages of the corpus pipeline, each on what its predecessor kept."""

from test_ops import brute_components, check_packing

import corpus_pipeline
from attestry.llm.common import durable


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = durable(stage(spark, docs, sf))
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "language":
            want = [r.doc_id for r in before.collect() if r.text and any(c.isalpha() for c in r.text)]
            assert sorted(r.doc_id for r in docs.collect()) == sorted(want)
        if name == "near_duplicates":
            roots = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert sorted(r.doc_id for r in docs.collect()) == sorted({c for _, c in roots.values()})
        if name == "mix":
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()} and docs.count() > 0
    rows = docs.collect()
    check_packing([(r.sequence_id, r.offset, r.length) for r in rows], 2048)
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept["mix"].collect()}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
