import hashlib
import random
from collections import Counter

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from phonolake.llm import alignment  # noqa: E402

SF = "/root/testdata/sf0.001"
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
ALPHABET = "aàÉΣİßfi '́ \x1c\x85​日本語한𝒳½_-!?'re\n\t#<|>é▁ "


def brute(rows):
    """Cut by sets of end offsets, one text at a time, with the library that owns each file."""
    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_letters()
    a.encode_special_tokens = True
    done, links = [], Counter()
    for doc_id, text in rows:
        raw = (" " + text).encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends = []
        for tokens in (bytes_a, bytes_b):
            at, out = 0, []
            for t in tokens:
                at += len(t)
                out.append(at)
            ends.append(out)
        groups, own, i, j = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append(",".join(map(str, ids_a[i:i2])) + "|" + ",".join(map(str, ids_b[j:j2])))
            own.append((ids_a[i2 - 1], ids_b[j2 - 1]))
            i, j = i2, j2
        links.update(own)
        written = ";".join(groups)
        done.append((doc_id, len(ids_a), len(ids_b), len(groups), own, hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    most = Counter()
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    return [(d, x, y, g, len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own), h) for d, x, y, g, own, h in done]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_given_texts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(alignment.cross_align(docs, A, B)) == sorted(want, key=repr)


def test_odd_texts_equal_brute_force(spark):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choice(ALPHABET) for _ in range(draw.randint(1, 80)))) for i in range(300)]
    rows += [(None, None), (None, "x"), (7, ""), (7, " "), (8, "same text"), (8, "same text"), (9, "a" * 50000), (10, "<|endoftext|> <s> <0x41>"), (11, "a▁b"), (12, "  two  \n\n ")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, pairs int, n_a int")
    got = rows_of(alignment.cross_align(docs.repartition(3), A, B))
    assert got == sorted(brute(rows), key=repr)
    assert (11, 0, 0, 0, 0, 0, 0, "") in got
    assert alignment.cross_align(docs.limit(0), A, B).count() == 0


def test_runs_cover_all_common_ends():
    draw = random.Random(3)
    for _ in range(300):
        n = draw.randint(1, 120)
        a, b = ([*sorted(draw.sample(range(1, n), draw.randint(0, n - 1))), n] for _ in range(2))
        if draw.random() < 0.5:
            b = [*a[: len(a) // 2], *[x for x in b if x > (a[len(a) // 2 - 1] if len(a) > 1 else 0)]]
        ends = [(a[i + k], b[j + k]) for i, j, size in alignment.diagonal_runs(np.array(a), np.array(b)) for k in range(size)]
        assert [x for x, _ in ends] == [y for _, y in ends] == sorted(set(a) & set(b))


def test_kept_groups_and_named_pairs(spark):
    docs = spark.createDataFrame([(1, "the unbelievable tokens")], "doc_id long, text string")
    rows = alignment.aligned(docs, A, B, keep_groups=True)
    first = rows.first()
    assert hashlib.sha256(first.groups.encode()).hexdigest() == first.groups_sha256
    named = alignment.pair_names(alignment.pair_counts(rows, A, B), A, B).collect()
    assert sum(r.times for r in named) == first.n_links
    assert {(r.a, r.b) for r in named} == {tuple(int(side.split(",")[-1]) for side in g.split("|")) for g in first.groups.split(";")}
