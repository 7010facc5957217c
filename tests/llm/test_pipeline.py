"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from tidemark.llm import quality
from tests.llm.test_operators import brute_links

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order_and_whole_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality.op2_quality_rules(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), name)
        assert docs.columns == COLUMNS
        left.append({r.doc_id for r in docs.collect()})
        assert left[-1] <= {r.doc_id for r in before.collect()}
    good, exact, near, mixed = left
    assert good == {d for d, kept in verdict.items() if kept}
    largest = {}
    for d in sorted(good):
        largest["".join(c.lower() if c.isascii() else c for c in texts[d])] = d
    assert exact == set(largest.values())
    ids = sorted(exact)
    _, root = brute_links([texts[d] for d in ids])
    classes = defaultdict(set)
    for i, d in enumerate(ids):
        classes[root(i)].add(d)
    assert all(len(near & members) == 1 for members in classes.values()) and len(near) == len(classes)
    words = Counter()
    for r in docs.collect():
        words[r.source] += len(r.text.encode().split())
    total = sum(len(texts[d].encode().split()) for d in near)
    assert abs(sum(words.values()) - 1.5 * total) <= len(words)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p.doc_id for p in pieces} == mixed
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((p.doc_id, p.start, p.length) for p in run) == sorted((p.doc_id, p.start, p.length) for p in pieces)
