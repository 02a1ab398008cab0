"""The pipeline's stages on the smallest tables, each against what it may do to its input."""

from __future__ import annotations

import corpus_pipeline
from graphloom.llm.common import documents


def test_stages(spark, small):
    docs = documents(spark, small)
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, small).persist()
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and set(ids) <= before
        if name != "source_mix":
            assert len(ids) == len(set(ids))
        else:
            assert max(ids.count(i) for i in set(ids)) <= 2
        counts.append(len(ids))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert len(out) == counts[-1] and counts[1] >= counts[2] >= counts[3]
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "source_mix", "token_output"]
