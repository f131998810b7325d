import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE, WordPiece
from tokenizers.pre_tokenizers import Split, Whitespace
from tokenizers.trainers import BpeTrainer

from phonolake.operators import encoding as E
from phonolake.operators import masking as M
from phonolake.operators import vocabulary as V
from phonolake.plans import corpora as PC
from phonolake.plans import examples as PE

SPECIAL = V.special_ids()


def corpus(seed, n=300):
    draw = random.Random(seed)
    syllables = ["an", "th", "er", "in", "é", "ou", "aa", "ing", "s", "b"]
    return ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(n)]


def counted(spark, words):
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    return V.word_frequencies(df, normalize=False)


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_equal_a_sequential_trainer(spark, seed):
    words = corpus(seed)
    vocab, merges = V.train_merges(counted(spark, words), vocab_size=80)
    model = Tokenizer(BPE(unk_token="[UNK]"))
    model.pre_tokenizer = Whitespace()
    model.train_from_iterator([" ".join(words)], BpeTrainer(vocab_size=80, special_tokens=list(V.SPECIALS), show_progress=False))
    assert dict(vocab.collect()) == model.get_vocab()
    ids = {r["word"]: r["ids"] for r in E.replay_merges(counted(spark, words), vocab, merges, 0).collect()}
    assert ids == {w: model.encode(w, add_special_tokens=False).ids for w in set(words)}


def test_small_candidate_window_gives_the_same_merges(spark):
    words = counted(spark, corpus(3))
    a = V.train_merges(words, vocab_size=30)[1].orderBy("rank").collect()
    for bounds in ({"most_pairs": 2}, {"most_runs": 3}):
        assert V.train_merges(words, vocab_size=30, **bounds)[1].orderBy("rank").collect() == a, bounds


def test_merges_that_make_known_tokens(spark):
    """Extra tokens are made again by merges, which ends a phase; the order must stay."""
    words = counted(spark, corpus(5))
    extra = ["ing", "er", "soub"]
    plain = V.train_merges(words, vocab_size=45)[1].orderBy("rank").collect()
    seeded = V.train_merges(words, vocab_size=48, extra_tokens=extra)[1].orderBy("rank").collect()
    short = V.train_merges(words, vocab_size=48, extra_tokens=extra, most_runs=40)[1].orderBy("rank").collect()
    assert seeded == short and len(seeded) >= len(plain)


def test_whole_size_equals_a_sequential_trainer(spark):
    """The library's own size on the given texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = V.word_frequencies(docs)
    vocab, _ = V.train_merges(counts, most_runs=20_000)
    model = Tokenizer(BPE(unk_token="[UNK]"))
    model.pre_tokenizer = Split("\x01", "removed")
    lines = ["\x01".join([r["word"]] * r["n"]) for r in counts.where("word <> ''").collect()]
    model.train_from_iterator(lines, BpeTrainer(vocab_size=V.VOCAB_SIZE, special_tokens=list(V.SPECIALS), show_progress=False))
    assert dict(vocab.collect()) == model.get_vocab()


def test_continuation_prefix(spark):
    vocab, merges = V.train_merges(counted(spark, ["abab", "abab", "ab", "ba"]), vocab_size=11, prefix="##")
    ids = dict(vocab.collect())
    assert list(ids)[5:9] == ["a", "b", "##a", "##b"]
    assert tuple(merges.orderBy("rank").first())[1:] == ("a", "##b") and "ab" in ids


def test_greedy_pieces_equal_wordpiece(spark):
    pieces = ["[UNK]", "a", "b", "ab", "##a", "##b", "##ab", "##bab", "é", "##é"]
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(pieces)], "token string, id int")
    words = ["a", "ab", "abab", "ababab", "ba", "c", "abc", "éa", "bab", "x" * 101, "a" * 100]
    got = {r["word"]: r["ids"] for r in E.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), vocab, 0).collect()}
    model = Tokenizer(WordPiece({t: i for i, t in enumerate(pieces)}, unk_token="[UNK]", max_input_chars_per_word=100))
    assert got == {w: model.encode(w).ids for w in words}


def test_wordlevel_vocab_orders_by_count_then_word(spark):
    counts = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9), ("d", 1)], "word string, n long")
    assert dict(V.vocab_wordlevel(counts, 8).collect()) == {**SPECIAL, "c": 5, "a": 6, "b": 7}


def test_unicode_normalization_counts(spark):
    df = spark.createDataFrame([("Été ÉTÉ ete", "x")], "text string, original_text string")
    assert dict(V.word_frequencies(df, ["text", "original_text"]).collect()) == {"ete": 3, "x": 1}
    with pytest.raises(ValueError):
        PC.train_vocabulary(df, "Other")


def truncated(n, m, budget):
    short, long, swapped = (n, m, False) if n <= m else (m, n, True)
    if n + m > budget:
        keep_long = max(short, budget - short) if short <= budget else short
        if short + keep_long > budget:
            short, keep_long = budget // 2, budget // 2 + budget % 2
        long = keep_long
    return (long, short) if swapped else (short, long)


def test_pair_truncation(spark):
    cases = [(n, m) for n in (0, 1, 3, 4, 5, 6, 9, 20) for m in (0, 1, 3, 4, 5, 6, 9, 20)]
    df = spark.createDataFrame([(list(range(n)), list(range(m))) for n, m in cases], "a array<int>, b array<int>")
    for length in (12, 13):
        rows = df.select(*[c.alias(f"k{i}") for i, c in enumerate(E.pair_lengths(F.col("a"), F.col("b"), length))]).collect()
        assert [tuple(r) for r in rows] == [truncated(n, m, length - 3) for n, m in cases]


def test_templates_and_padding(spark):
    df = spark.createDataFrame([(1, "a b zz", "c"), (2, "", "")], "doc_id long, s1 string, s2 string")
    table = spark.createDataFrame([("a", [10]), ("b", [11, 12]), ("c", [13])], "word string, ids array<int>")
    rows = PE.pair_examples(df, table, SPECIAL, ("s1", "s2")).orderBy("doc_id").collect()
    assert rows[0]["input_ids"] == [1, 10, 11, 12, 0, 2, 13, 2] and rows[0]["token_type_ids"] == [0] * 6 + [1] * 2
    assert rows[1]["input_ids"] == [1, 2, 2]
    single = PE.single_examples(df.withColumnRenamed("s1", "text"), table, SPECIAL, 5).orderBy("doc_id")
    assert single.first()["input_ids"] == [1, 10, 11, 12, 2]
    padded = E.pad_fixed(single, SPECIAL, 6).collect()[1]
    assert padded["input_ids"] == [1, 2, 3, 3, 3, 3] and padded["attention_mask"] == [1, 1, 0, 0, 0, 0]
    dynamic = E.pad_dynamic(single.withColumn("batch", F.lit(0)), SPECIAL).orderBy("doc_id").collect()
    assert [len(r["input_ids"]) for r in dynamic] == [5, 5]


def long_rows(spark, parts):
    draw = random.Random(6)
    rows = [(i, [[draw.randint(5, 99) for _ in range(draw.randint(1, 3))] for _ in range(draw.randint(1, 60))],
             [[draw.randint(5, 99) for _ in range(draw.randint(1, 3))] for _ in range(draw.randint(1, 60))]) for i in range(120)]
    return spark.createDataFrame(rows, "id long, a array<array<int>>, b array<array<int>>").repartition(parts)


def built(spark, parts):
    kinds = long_rows(spark, parts).withColumn("k", M.aligned_word_kinds(F.col("a"), F.col("b"), F.col("id"), 62))
    return kinds.withColumn("e", M.bilingual_example(F.col("a"), F.col("b"), F.col("k"), F.col("id"), SPECIAL, 100)).orderBy("id").collect()


def test_aligned_masks_share_words_and_types(spark):
    rows = built(spark, 4)
    assert rows == built(spark, 1)
    seen = []
    for r in rows:
        assert all(len(r["e"][c]) == 128 for c in ("input_ids", "attention_mask", "token_type_ids", "labels"))
        n = min(len(r["a"]), len(r["b"]))
        chosen = {}
        for side, words in (("normal", r["a"]), ("phonetic", r["b"])):
            kinds, at = r["k"][side], 0
            assert len(kinds) == min(62, sum(map(len, words)))
            for i, ids in enumerate(words):
                part = set(kinds[at : at + len(ids)])
                at += len(ids)
                assert len(part) <= 1
                if part and part != {0}:
                    assert i < n and chosen.setdefault(i, part) == part
        assert len(chosen) <= max(1, int(n * 0.15 + 1e-9))
        if all(sum(map(len, w)) <= 62 for w in (r["a"], r["b"])):
            assert len(chosen) == max(1, int(n * 0.15 + 1e-9))
        seen += [k for part in chosen.values() for k in part]
        one = [x for w in r["a"] for x in w][:62]
        two = [x for w in r["b"] for x in w][:62]
        plain = [1, *one, 2, *two, 2]
        marks = [0, *r["k"]["normal"], 0, *r["k"]["phonetic"], 0]
        for i, (x, kind) in enumerate(zip(plain, marks)):
            got, label = r["e"]["input_ids"][i], r["e"]["labels"][i]
            assert label == (x if kind else -100)
            assert got == x if kind in (0, 3) else got == 4 if kind == 1 else 5 <= got < 100
        assert r["e"]["input_ids"][len(plain):] == [3] * (128 - len(plain))
        assert r["e"]["token_type_ids"] == [0] * (len(one) + 2) + [1] * (len(two) + 1) + [0] * (128 - len(plain))
    assert abs(seen.count(1) / len(seen) - 0.8) < 0.08


def test_random_masking_rates(spark):
    df = spark.range(60).select("id", F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(50), 100), F.array(F.lit(2))).alias("ids"))
    rows = df.select(M.mlm_mask(F.col("ids"), F.col("id"), SPECIAL, 1000).alias("m")).select("m.*").collect()
    labels = [x for r in rows for x in r["labels"]]
    masked = [y for r in rows for x, y in zip(r["labels"], r["input_ids"]) if x != -100]
    assert all(r["labels"][0] == r["labels"][-1] == -100 for r in rows)
    assert abs(len(masked) / (len(labels) - 120) - 0.15) < 0.02 and abs(masked.count(4) / len(masked) - 0.8) < 0.05


def test_target_mask(spark):
    df = spark.createDataFrame([([1, 7, 8, 9, 2, 6, 2], 2), ([1, 7, 2, 6, 2], 3)], "ids array<int>, n int")
    rows = df.select(M.mask_before_sep(F.col("ids"), F.col("n"), SPECIAL).alias("m")).select("m.*").collect()
    assert rows[0]["input_ids"] == [1, 7, 4, 4, 2, 6, 2] and rows[0]["labels"] == [-100, -100, 8, 9, -100, -100, -100]
    assert rows[1]["input_ids"] == [1, 7, 2, 6, 2] and set(rows[1]["labels"]) == {-100}


def test_dual_encoding_swaps(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, original_text string")
    table = spark.createDataFrame([("a", [10]), ("b", [11])], "word string, ids array<int>")
    plain = PE.dual_examples(df, table, table, SPECIAL, max_length=4).first()
    swapped = PE.dual_examples(df, table, table, SPECIAL, inverse=True, max_length=4).first()
    assert plain["teacher_input_ids"] == [1, 11, 2, 3] == swapped["student_input_ids"]
    assert PE.collate_dual(PE.dual_examples(df, table, table, SPECIAL, max_length=4), SPECIAL, 20).first()["teacher_input_ids"] == [1, 11, 2, 3]


def test_decoding(spark):
    df = spark.createDataFrame([(1, [1, 5, 6, 2]), (2, [1, 2])], "doc_id long, input_ids array<int>")
    vocab = spark.createDataFrame([("[CLS]", 1), ("[SEP]", 2), ("x", 5), ("y", 6)], "token string, id int")
    assert dict(E.decode_ids(df, vocab, skip=[1, 2]).collect()) == {1: "x y", 2: ""}


def test_batches_are_bounded(spark):
    df = spark.range(1000).repartition(3)

    def predict(frame):
        assert len(frame) <= 256
        return frame.assign(score=frame["id"] * 2.0)

    rows = E.batch_score(df, predict, ["id"], "id long, score double").collect()
    assert len(rows) == 1000 and all(r["score"] == 2 * r["id"] for r in rows)


def test_held_and_joined_encoding_agree(spark, monkeypatch):
    """Repeated and null ids, null and empty texts, unknown words, tables in several parts and tables too large to hold."""
    from phonolake.operators import held

    monkeypatch.setattr(held, "AT_ONCE", 7)
    texts = [" ".join(corpus(k, k % 9)) for k in range(40)]
    rows = [(k, t, texts[-k]) for k, t in enumerate(texts)] + [(100, None, "an th"), (101, "", None), (None, "th an", "x"), (102, " \n", "é")]
    twice = [(3, "er in unknown", "b"), (3, "an", ""), (None, "ing", "s s")]
    table = spark.createDataFrame([(w, [k, k + 1][: 1 + k % 2]) for k, w in enumerate(sorted(set(corpus(8, 60) + ["an", "th", "er"])))], "word string, ids array<int>").localCheckpoint()
    fields = {"text": "a", "other": "b"}
    key = lambda df: sorted(map(str, df.collect()))
    for data in (rows[:-2] + rows[-1:], rows, rows + twice):
        df = spark.createDataFrame(data, "doc_id long, text string, other string")
        joined = key(E.encode_joined(df, table, 0, fields))
        for most in (held.MOST_BYTES, 1200, 1):
            assert key(E.encode_texts(df, table, 0, fields, most_bytes=most)) == joined, most


def test_encoding_shuffles_no_tokens(spark, capsys):
    df = spark.createDataFrame([(1, "an th"), (2, "er")], "doc_id long, text string").localCheckpoint()
    table = spark.createDataFrame([("an", [1])], "word string, ids array<int>").localCheckpoint()
    PE.single_examples(df, table, SPECIAL).explain()
    assert "Exchange" not in capsys.readouterr().out
    vocab = spark.createDataFrame([(1, "an"), (2, "th")], "id int, token string").localCheckpoint()
    ids = spark.createDataFrame([(1, [1, 2, 9]), (1, [2, None, 1]), (2, None), (None, [1])], "doc_id long, input_ids array<int>")
    assert sorted(map(str, E.decode_ids(ids, vocab).collect())) == sorted(map(str, [spark.createDataFrame([(1, "an th th an"), (2, ""), (None, "an")], "doc_id long, text string").collect()][0]))
    E.decode_ids(ids, vocab).explain()
    assert "Generate" not in capsys.readouterr().out


def test_phases_replace_runs_and_drop_finished_words():
    """Runs are looked up by what a phase made of them; a word that became one symbol has no pairs left."""
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array([5, 2, 7, 1], pa.int64()), pa.array(["abc", "abxab", "q", "xcab"], pa.string())], ["n", "seg"])
    (out,) = V._merged({"ab", "bc"}, {"abc": "Z", "ab": "Y"})([rows])
    assert out.to_pydict() == {"n": [2, 1], "seg": ["YxY", "xcY"]}


def test_pieces_give_the_counts_of_whole_texts(spark):
    """Transcription and original count the same by distinct pieces, whatever stands between words."""
    from phonolake.operators import lexicon as G
    from phonolake.plans import corpora as PC

    texts = ["Hello, chair chair x--y", "", None, " tion,ß. \n chair ", "ÉTÉ's (chair)   a_b 9 ... ,", "matin, matin vin. vin"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([("x", ["a", "E~"]), ("hello", [" ", "h", "-"])], "word string, phonemes array<string>")
    want = V.word_frequencies(G.translate_corpus(docs, known), ("text", "original_text"))
    pieces = V.spaced_pieces(docs)
    got = V.word_frequencies(G.translate_corpus(pieces, known, id_col="text"), ("text", "original_text"), weight="n")
    assert pieces.count() < sum(len((t or "").split()) for t in texts)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    a = PC.train_phonetic_vocabulary(docs, known, "BPE", size=60)
    b = PC.train_vocabulary(G.translate_corpus(docs, known), "BPE", size=60)
    assert [x.orderBy(x.columns).collect() for x in a] == [x.orderBy(x.columns).collect() for x in b]


def test_runs_and_replacements_by_column():
    """Runs of a phase and what takes their place, against a reading symbol by symbol; sliced columns and empty ones."""
    import random

    import pyarrow as pa

    draw = random.Random(5)
    words = ["".join(V._code(draw.randrange(6)) for _ in range(draw.randint(1, 9))) for _ in range(300)]
    counts = [draw.randint(1, 2**55) for _ in words]
    active = {V._code(a) + V._code(b) for a, b in ((0, 1), (1, 2), (2, 2), (4, 0))}
    changed = {V._code(0) + V._code(1): V._code(70_000), V._code(2) + V._code(2): V._code(9)}

    def cut(word):
        runs = [word[0]]
        for a, b in zip(word, word[1:]):
            runs[-1:] = [runs[-1] + b] if a + b in active else [runs[-1], b]
        return runs

    sums: dict[str, int] = {}
    for word, n in zip(words, counts):
        for run in cut(word):
            if len(run) > 1:
                sums[run] = sums.get(run, 0) + n
    whole = pa.RecordBatch.from_arrays([pa.array(counts), pa.array(words)], ["n", "seg"])
    batches = [whole.slice(0, 0), whole.slice(0, 70), whole.slice(70)]
    got: dict[str, int] = {}
    for batch in V._runs(active)(iter(batches)):
        for run, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got[run] = got.get(run, 0) + n
    assert got == sums
    want = [(n, w) for n, w in zip(counts, ("".join(changed.get(r, r) for r in cut(word)) for word in words)) if len(w) > 1]
    made = [row for batch in V._merged(active, changed)(iter(batches)) for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    assert made == want and not list(V._merged(active, changed)(iter([whole.slice(0, 0)])))
