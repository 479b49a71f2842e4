"""Stages one by one against the operators' own verdicts, and the whole run."""

from collections import Counter

import corpus_pipeline as cp
from cadenza.llm import quality_rules, weak_labels
from cadenza.llm.queries import PIECES
from test_minhash_join import plain_components
from test_packing import check, tokenizer  # noqa: F401


def test_stages_take_effect(spark, small, documents, tokenizer):  # noqa: F811
    assert [name for name, _ in cp.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "packing"]
    kept = {r["doc_id"] for r in quality_rules.quality_rules(documents, PIECES).where("kept").collect()}
    docs = cp.rules(spark, documents, small)
    assert docs.columns == documents.columns and {r["doc_id"] for r in docs.collect()} == kept

    labels = spark.read.parquet(f"{small}/labels.parquet")
    judged = {r["doc_id"] for r in weak_labels.classify_documents(docs, labels).where("kept").collect()}
    docs = cp.classifier(spark, docs, small)
    assert docs.columns == documents.columns and {r["doc_id"] for r in docs.collect()} == judged

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    firsts = {k for k, _, c in plain_components(rows, cp.SHINGLE_WORDS) if k == c}
    docs = cp.near_dedup(spark, docs, small)
    assert docs.columns == documents.columns
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left) == firsts

    out = cp.run(spark, small).collect()
    assert {r["doc_id"] for r in out} == firsts
    check(out, list(left.items()), tokenizer)


def test_odd_documents(spark, small, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for _, stage in cp.STAGES:
            before = Counter(r["doc_id"] for r in docs.collect())
            docs = stage(spark, docs, small)
            assert not set(r["doc_id"] for r in docs.collect()) - set(before)
