"""The pipeline's stages, each on what the one before it kept, against brute force.

Null, empty and repeated rows and empty tables are tested with the operators.
"""

import collections

import corpus_pipeline as cp
from rollscope.llm import pii
from rollscope.llm.common import cut, read_table
from tests.llm.test_dedup import brute
from tests.llm.test_operators import base_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs.collect(), cut(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen[name] = (before, docs.collect())
    before, kept = seen["quality_rules"]
    failed = {r.doc_id for r in before if base_rules(r.text)[-1]}
    good = {r.doc_id for r in read_table(spark, SF, "labels").where("quality = 1").collect()} - failed
    ids = {r.doc_id for r in kept}
    assert not ids & failed and good <= ids < {r.doc_id for r in before}
    before, kept = seen["minhash_near_dedup"]
    assert sorted(r.doc_id for r in kept) == sorted(set(brute([(r.doc_id, r.text) for r in before]).values()))
    before, kept = seen["pii_pseudonyms"]
    k = pii.Pseudonyms(pii.session_key(spark))
    assert {r.doc_id: r.text for r in kept} == {r.doc_id: pii.pseudonymise_text(r.text, k)[0] for r in before}
    before, kept = seen["temperature_mixing"]
    times = collections.Counter(r.doc_id for r in kept)
    assert set(times) == {r.doc_id for r in before} and max(times.values()) <= 3
    packed = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == times
