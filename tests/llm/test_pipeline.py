"""The pipeline on the small tables: every stage keeps what its operator says, and only that."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.llm import data
from usagelake.llm import decontaminate, language, mixing, simhash
from usagelake.llm.common import read, stage
from usagelake.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SMALL, "documents")
    names = docs.columns
    kept = [docs]
    for _, apply in corpus_pipeline.STAGES:
        kept.append(stage(apply(spark, kept[-1], SMALL)))
    ids = [{r[0] for r in k.select("doc_id").collect()} for k in kept]
    assert all(k.columns == names for k in kept[:-1])
    told = language.identify(docs)
    assert ids[1] == {r["doc_id"] for r in told.where("lang_pred <> 'und' AND score >= 0.5").collect()}
    near = simhash.near_duplicates(kept[1])
    assert ids[2] == {r["component_id"] for r in near.collect()}
    found = decontaminate.find(kept[2], read(spark, SMALL, "benchmark"))
    assert ids[3] == {r["doc_id"] for r in found.where("n_hit = 0").collect()}
    copies = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(kept[3]).where("copies > 0").collect()})
    assert Counter(r["doc_id"] for r in kept[4].collect()) == copies
    assert kept[5].count() == kept[4].count()
    whole = corpus_pipeline.run(spark, SMALL)
    order = sorted(whole.columns)
    assert Counter(map(tuple, whole.select(order).collect())) == Counter(map(tuple, kept[5].select(order).collect()))


def test_stages_stand_odd_documents(spark):
    documents = data.plain(30) + data.odd()
    for rows in (documents, []):
        docs = data.frame(spark, rows, clash=True)
        for name, apply in corpus_pipeline.STAGES[:-1]:
            out = apply(spark, docs, SMALL)
            assert set(out.columns) == set(docs.columns), name
            assert out.count() <= 3 * len(rows), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == len(rows)


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
