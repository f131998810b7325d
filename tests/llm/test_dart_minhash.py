import random
from collections import Counter

import numpy as np

from phonolake.llm import dart_minhash
from phonolake.llm.components import components
from phonolake.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"


def counted(text, words=5):
    w = text.lower().split()
    return Counter(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum((a | b).values()) or 1)


def brute(rows):
    """Smallest id of the component of each text; equal texts belong together."""
    texts = sorted({t or "" for _, t in rows})
    bags, root = [counted(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    at = {t: find(i) for i, t in enumerate(texts)}
    low = {}
    for i, t in rows:
        key = -(2**63) if i is None else i
        low[at[t or ""]] = min(low.get(at[t or ""], key), key)
    return {(i, t): (None if low[at[t or ""]] == -(2**63) else low[at[t or ""]]) for i, t in rows}


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(3)
    elements = draw.integers(0, 2**63, 400).astype(np.uint64)
    left, right = draw.uniform(0.05, 9, 400), draw.uniform(0.05, 9, 400)
    right[:300] = left[:300]
    doc = np.repeat([0, 1], 400)
    sig = dart_minhash.signatures(doc, np.tile(elements, 2), np.concatenate([left, right]), 2, 2000)
    true = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    assert (sig != 0).all() and abs((sig[0] == sig[1]).mean() - true) < 0.04


def test_table_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = LLM_QUERIES["op10_dart_minhash"](spark, SF).collect()
    want = {i: c for (i, _), c in brute(rows).items()}
    assert {r.doc_id: r.class_id for r in got} == want and len(got) == len(rows)
    assert {r.doc_id for r in got if r.is_first} == set(want.values())


def test_star_around_a_base_and_chain(spark):
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # each near the base, most not near each other
        words = list(base)
        for p in draw.sample(range(300), 6):
            words[p] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    chain = [f"c{k}" for k in range(200)]
    rows += [(100 + i, " ".join(chain[8 * i :] + [f"d{k}" for k in range(8 * i)])) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(docs).collect()}
    assert got == {i: c for (i, _), c in brute(rows).items()}


def test_texts_around_one_passage(spark):
    draw = random.Random(9)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for i in range(80):
        own = [f"o{draw.randrange(10**7)}" for _ in range(draw.randrange(1, 45))]
        cut = draw.randrange(len(own) + 1)
        rows.append((i, " ".join(own[:cut] + passage + own[cut:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(docs, hub_rounds=1).collect()}
    assert got == {i: c for (i, _), c in brute(rows).items()}


def test_prefix_join_loses_no_link(spark):
    draw = random.Random(11)
    texts = []
    for n in (30, 120, 900):  # the longest fill their bit maps
        base = [f"b{n}_{i}" for i in range(n)]
        for _ in range(30):
            words = list(base)
            start = draw.randrange(n - n // 5)
            words[start : start + draw.randrange(n // 6)] = [f"o{draw.randrange(10**7)}" for _ in range(draw.randrange(n // 10))]
            texts.append(" ".join(words))
    texts += ["same " * 50, "same " * 60, "same " * 90]
    names = [i.to_bytes(4, "big") for i in range(len(texts))]
    open_ = spark.createDataFrame(list(zip(map(bytearray, names), map(bytearray, names), strict=True)), "node binary, label binary")
    bodies = spark.createDataFrame(list(zip(map(bytearray, names), texts, strict=True)), "node binary, text string")
    got = {(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in dart_minhash.prefix_pairs(open_, bodies, 5, 0.8).collect()}
    bags = [counted(t) for t in texts]
    linked = {(i, j) for j in range(len(texts)) for i in range(j) if jaccard(bags[i], bags[j]) >= 0.8}
    assert linked <= got and len(linked) > 100
    sizes = [sum(b.values()) for b in bags]
    # short texts have hardly two differing elements in one bit, so hardly any other pair is left
    assert len([p for p in got - linked if max(sizes[p[0]], sizes[p[1]]) < 150]) < len(linked) / 5


def test_edges(spark):
    long = " ".join(f"t{i % 9000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (4, "a b"), (None, "x y z u v w"), (7, "x y z u v w"), (8, long), (9, long + " end"), (10, " \n ")]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, bucket int, node string")
    got = dart_minhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == sorted((str(i), str(brute(rows)[(i, t)])) for i, t in rows)
    kept = dart_minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "3", "8", "None"]
    empty = spark.createDataFrame([], docs.schema)
    assert dart_minhash.near_duplicates(empty).count() == 0 and dart_minhash.keep_first(empty).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8)] + [(i, i + 1) for i in range(20, 90)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {i: 20 for i in range(20, 91)}


def test_own_columns_named_like_keys_stay(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "a", 5), (2, text, "b", 6), (3, None, None, None)], "doc_id long, text string, _key_id string, _key_hash int")
    kept = dart_minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(1, text, "a", 5), (3, None, None, None)]
