import hashlib
import random

import pytest

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from phonolake.llm import bpe  # noqa: E402

ALPHABET = "aàÉΣσİßfi '́ \x1c\x85​日本語中한국𝒳٣½²_-!?'s're\n\t#<|>é́ǅ"


def odd_texts():
    draw = random.Random(1)
    fixed = ["", " ", "a" * 3000, "=" * 5000, "日本語" * 500, "<|endoftext|>x <|startoftext|>", "ΑΣ ΣΑΣ", "don't we're", "  two  spaces "]
    return fixed + ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(1, 60))) for _ in range(800)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    library, own = Tokenizer.from_file(public.path(name)), bpe.loaded(public.path(name))
    for text, ids in zip(odd_texts(), own.encode_batch(odd_texts()), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == b"".join(i.to_bytes(4, "little") for i in expected), text


def test_round_trip_rows(spark):
    path = public.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t, "x") for i, t in enumerate(odd_texts())] + [(None, None, None), (3, None, "y"), (3, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    got = sorted(tuple(r) for r in bpe.encode_decode(docs, path).na.fill(-1).collect())
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        back = library.decode(ids, skip_special_tokens=False).encode()
        want.append((-1 if doc_id is None else doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()))
    assert got == sorted(want)


def test_empty_table_and_kept_ids(spark):
    path = public.path("word_bpe_49k.json")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(docs, path).count() == 0
    row = bpe.encode_decode(spark.createDataFrame([(1, "The MIT License")], "doc_id long, text string"), path, keep_ids=True).first()
    assert row.decoded == "the</w> mit</w> license</w>" and len(row.ids) == 12
