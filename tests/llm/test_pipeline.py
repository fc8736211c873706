from collections import Counter

import corpus_pipeline as C

from lumaveil.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, Counter(r.doc_id for r in docs.collect())
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        now = Counter(r.doc_id for r in docs.collect())
        assert now and set(now) <= set(before), name
        if name != "mixing":
            assert all(n <= before[d] for d, n in now.items())
        before = now
    pieces = C.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(before)
    whole = Counter()
    for r in pieces:
        whole[r.doc_id] += r.length
    total = {r.doc_id: r.doc_tokens for r in pieces}
    assert all(whole[d] == before[d] * total[d] for d in before)
    assert C.run(spark, SF).count() > 0


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
