import hashlib
import random
from collections import Counter

import numpy as np

from phonolake.llm import suffix_dedup
from phonolake.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[p : p + length] for _, d in data for p in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d) + 2, bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p + 1 : p + 1 + length] = True
        kept = bytes(b for b, g in zip(d, gone[1:-1], strict=True) if not g)
        out.append((str(i), len(d), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, rows, length):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string")
    got = sorted((str(r.doc_id), *r[1:]) for r in suffix_dedup.remove_repeats(docs, length).collect())
    assert got == brute(rows, length)
    return got


def test_table_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((str(r.doc_id), *r[1:]) for r in LLM_QUERIES["op4_suffix_dedup"](spark, SF).collect())
    want = brute(rows, 400)
    assert got == want and sum(r[2] for r in want) > 0


def test_borders_shifts_and_periods(spark):
    draw = random.Random(8)
    make = lambda n, letters="abcdefgh ": "".join(draw.choice(letters) for _ in range(n))
    shared = [make(n) for n in (149, 150, 151, 190, 400, 700)]
    rows = []
    for i in range(60):
        parts = [make(draw.randrange(400))]
        for _ in range(draw.randrange(3)):
            s = draw.choice(shared)
            a = draw.randrange(0, 40)
            parts += [s[a : len(s) - draw.randrange(0, 30)], make(draw.randrange(3))]
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 700), (101, "ab" * 300), (102, "ba" * 200), (103, "é" * 400), (104, "abc" * 90), (105, make(3000, "ab")), (106, "\x00" * 200 + "x")]
    check(spark, rows, 150)


def test_edges(spark):
    long = "".join(f"{i * i % 9973} " for i in range(260_000))
    rows = [(1, None), (2, ""), (3, "short"), (None, "q" * 10 + "".join(map(str, range(300)))), (4, "".join(map(str, range(300)))), (4, "".join(map(str, range(300))))]
    check(spark, rows, 132)
    docs = spark.createDataFrame([(7, long + "!"), (8, "?" + long)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[7].n_removed == len(long) and got[8].n_removed == len(long) and got[7].kept_sha256 == hashlib.sha256(b"!").hexdigest()
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    assert suffix_dedup.remove_repeats(docs.limit(1), keep_bytes=True).first().kept is not None


def test_blocks_cover_each_start_once():
    data = np.random.default_rng(1).integers(97, 100, 3 * suffix_dedup.STRETCH).astype(np.uint8)
    found = suffix_dedup.blocks_of(data, 400)
    assert found[0, 0] == 0 and (np.diff(found[:, 0]) == found[:-1, 1]).all() and found[:, 1].sum() == len(data) - 399
    assert (found[:, 2] >= found[:, 0] + found[:, 1] - 1).all() and (found[:, 2] - found[:, 0] <= 300).all()


def test_sorting_of_one_bucket():
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab") for _ in range(60)) for _ in range(30)] + ["ab" * 40, "ba" * 40, "a" * 80]
    starts = [len(t) - 40 + 1 for t in texts]
    seen = Counter(t[s : s + 40] for t, n in zip(texts, starts, strict=True) for s in range(n))
    for flags, t in zip(suffix_dedup.repeated_starts([t.encode() for t in texts], starts, 40), texts, strict=True):
        assert flags.tolist() == [seen[t[s : s + 40]] > 1 for s in range(len(t) - 39)]
