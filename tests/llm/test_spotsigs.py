import hashlib
from itertools import islice

import numpy as np

from phonolake.llm import spotsigs
from phonolake.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"


def chains(text):
    """Signature chains by plain loops."""
    words = spotsigs.WORD.findall(text.lower())
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            after = list(islice((x for x in words[i + 1 : i + 200] if x not in spotsigs.ANCHORS), spotsigs.CHAIN))
            if len(after) == spotsigs.CHAIN:
                out.add((w, *after))
    return out or {tuple(words[i : i + 1 + spotsigs.CHAIN]) for i in range(len(words))}


def brute(rows):
    order = sorted(((-(2**63) if i is None else i), t or "") for i, t in rows)[::-1]
    out = {}
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(text)
        changed = text[: n - n // 2] + following[: n // 2]
        a, b, c = chains(text), chains(changed), chains(following)
        alike = [len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c)]
        out[i] = (n, hashlib.sha256(changed.encode()).hexdigest(), len(a), *alike)
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, run string").repartition(4)
    got = spotsigs.fingerprint_edits(docs, **options).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        n, digest, size, near_edited, near_next = want[-(2**63) if r.doc_id is None else r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.n_signatures) == (n, digest, size)
        assert np.allclose((r.near_edited, r.near_next), (near_edited, near_next))
    return got


def test_table_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for runs in (1, 3, 50):
        got = check(spark, rows, runs=runs)
    assert len({r.fingerprint for r in got}) > 50
    query = LLM_QUERIES["op8_spotsigs"](spark, SF).drop("n_signatures").collect()
    assert {(r.doc_id, r.fingerprint) for r in query} == {(r.doc_id, r.fingerprint) for r in got}
    plain = spotsigs.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {(r.doc_id, r.fingerprint) for r in plain} == {(r.doc_id, r.fingerprint) for r in got}


def test_edges(spark):
    check(spark, [(5, "only the one text is here")])
    check(spark, [(1, None), (2, ""), (None, "x"), (4, "the a b " * 2_000), (5, "ß" * 7), (6, "the quick fox 𝒳 is in the house")], runs=3)
    docs = spark.createDataFrame([(3, "the same row is here twice"), (3, "the same row is here twice"), (3, "an other is there")], "doc_id long, text string")
    got = spotsigs.fingerprint_edits(docs).collect()
    assert len(got) == 3 and len({r.fingerprint for r in got}) == 2
    assert spotsigs.fingerprint_edits(docs.limit(0)).count() == 0


def test_pruning():
    a, b = np.arange(10, dtype=np.uint32), np.arange(5, dtype=np.uint32)
    assert spotsigs.likeness(a, b) == 0.5 and spotsigs.likeness(a, b, 0.6) == 0.0 and spotsigs.likeness(a, a, 0.9) == 1.0
