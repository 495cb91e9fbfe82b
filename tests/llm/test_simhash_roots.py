"""Unlike documents that share an id, or have none, are no copies."""

from chatlake.llm import simhash

A = "the quick brown fox jumps over the lazy dog near the old river bank today"
B = "completely different words about cooking rice with saffron and green peas"
C = "a third text that speaks of ships and harbours and of the winds at sea"


def test_unlike_documents_without_id_or_with_one_id_stay(spark):
    rows = [(None, A), (None, B), (None, B), (None, None), (7, A + " again"), (7, C), (7, C)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicate(docs).collect()), key=repr)
    near = (simhash.fingerprint(A) ^ simhash.fingerprint(A + " again")).bit_count() <= simhash.RADIUS
    want = [(None, B), (None, None), (7, A + " again"), (7, C)] + ([] if near else [(None, A)])
    assert got == sorted(want, key=repr)
    assert len({r.root for r in simhash.clusters(docs).collect()}) == len(want)
