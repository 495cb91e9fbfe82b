"""The whole pipeline against a brute-force version."""

from brute import contamination, dedup_lines, mix, near_prints, simhash
from cases import SF001, edge, empty  # noqa: F401
from oracle_util import duck

import corpus_pipeline
from chatlake.llm import toxicity
from chatlake.llm.common import table
from chatlake.llm.queries import MIX_WEIGHTS


def test_pipeline_matches_brute_force(spark):
    con = duck(SF001)
    docs = con.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    source = {d: s for d, _, s in docs}
    model = toxicity.train(table(spark, SF001, "documents"), table(spark, SF001, "labels"), toxicity.label_grade())
    left = [(d, t) for d, t, _ in docs if model.severity(toxicity.features(t)) < toxicity.THRESHOLD]
    assert len(left) < len(docs)
    left = dedup_lines(left)
    comp = near_prints([simhash(t) for _, t in left])
    left = [x for i, x in enumerate(left) if comp[i] == i]
    left = [(d, t) for d, t in left if not contamination(t, items)[-1]]
    places = mix([(d, source[d]) for d, _ in left], MIX_WEIGHTS)
    got = corpus_pipeline.run(spark, SF001).collect()
    assert {r.doc_id: (r.text, r.n_chars, r.block, r.pos, r.slot) for r in got} == {
        d: (t, len(t), *places[d]) for d, t in left}
    assert len(got) == len(left)


def test_stages_keep_the_columns(spark, edge, empty):
    for docs in (edge, empty):
        start = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF001)
            assert docs.columns == edge.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
        assert out.count() == docs.count() <= start
