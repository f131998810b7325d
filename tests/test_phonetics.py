import re

import pytest
from pyspark.sql import functions as F

from phonolake.functions import phonetic as P
from phonolake.operators import language as L
from phonolake.operators import lexicon as G
from phonolake.plans import corpora as PC
from phonolake.plans import tasks as PT


@pytest.fixture()
def lexicon(spark):
    return spark.createDataFrame(
        [("hello", ["h", "@", "l", "oU"]), ("to", ["t", "u"]), ("you", ["j", "u"]), ("a", ["@"])],
        "word string, phonemes array<string>",
    )


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def by_id(df, column="text"):
    return [r[column] for r in df.orderBy("doc_id").collect()]


RENDERS = [
    dict(),
    dict(splitter=G.X.whitespace_words, render=G.spaced),
    dict(splitter=G.X.split_words_and_gaps, render=G.ipa, glue=""),
]


@pytest.mark.parametrize("options", RENDERS)
def test_held_lexicon_equals_the_join(spark, lexicon, options):
    df = texts(spark, "Hello, to YOU a you", "", None, "a-b ... x", "zz Hello" * 50).withColumn("_sounds_", F.lit(1))
    want = by_id(G.transcribe_joined(df, lexicon, **options))
    assert by_id(G.transcribe(df, lexicon, **options)) == want
    # a bound below the lexicon deals it into parts, a lower one joins
    assert len(G.hold(lexicon.select("word", G.joined("phonemes").alias("sound")), ["sound"], most_bytes=40).parts) > 1
    assert by_id(G.transcribe(df, lexicon, most_bytes=40, **options)) == want
    assert G.hold(lexicon.select("word", G.joined("phonemes").alias("sound")), ["sound"], most_bytes=5) is None
    assert by_id(G.transcribe(df, lexicon, most_bytes=5, **options)) == want
    assert by_id(G.transcribe(df, lexicon.limit(0), **options)) == by_id(G.transcribe_joined(df, lexicon.limit(0), **options))


def test_large_lexicon_shuffles_no_token(spark):
    """Far above the broadcast threshold of the session, the plan has no exchange."""
    entries = spark.range(400_000).select(F.concat(F.lit("word"), "id").alias("word"), F.array(F.concat(F.lit("w"), "id"), F.lit("x"), F.repeat(F.lit("y"), 60)).alias("phonemes"))
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("word"), F.col("id") * 399), F.lit("unknown")).alias("text"))
    out = G.phonetize_words(df, entries)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r["text"].split(" ")[0] for r in out.collect()}
    assert got == {i: f"w{i * 399}x" + "y" * 60 for i in range(1000)}


def rule_phonemes(word):
    table = dict(P.RULES)
    return [p for g in re.findall(P.GRAPHEME_PATTERN, word.lower()) for p in table[g]]


def test_a_second_rule_table_gives_a_second_transcription(spark):
    rows = [(2, "a", ["x"]), (1, "ab", ["y", "z"]), (3, "AB", ["never"]), (4, "c+", ["plus"]), (5, None, ["n"]), (6, "q", None), (0, "", ["e"])]
    table = spark.createDataFrame(rows, "rank int, grapheme string, phonemes array<string>")
    rules = P.rules_from_table(table)
    words = spark.createDataFrame([("abac+c",), ("",), (None,), ("q",), ("BA",)], "word string")
    got = {r.word: r.p for r in words.select("word", P.apply_grapheme_rules(F.col("word"), rules).alias("p")).collect()}
    assert got == {"abac+c": ["y", "z", "x", "plus"], "": [], None: None, "q": [], "BA": ["x"]}
    none = P.rules_from_table(table.limit(0))
    assert words.select(P.apply_grapheme_rules(F.col("word"), none).alias("p")).where("size(p) > 0").count() == 0
    with pytest.raises(ValueError, match="more than 3"):
        P.rules_from_table(table, most=3)
    assert {r.word: r.phonemes for r in G.build_lexicon(words, rules=rules).collect()}["ba"] == ["x"]


def test_rules_take_the_longest_spelling(spark):
    words = ["Nation", "thought", "light", "queue", "x-ray", "straße", "", "123", "ÉCLAIR"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: r["p"] for r in df.select("word", P.apply_grapheme_rules(F.col("word")).alias("p")).collect()}
    assert got == {w: rule_phonemes(w) for w in words}
    assert got["light"] == ["l", "aI", "t"] and got["123"] == []


def test_lexicon_is_one_row_per_word(spark):
    known = spark.createDataFrame([("Hello", ["b"]), ("hello", ["a"])], "word string, phonemes array<string>")
    words = spark.createDataFrame([("hello",), ("HELLO",), ("ship",)], "word string")
    assert dict(G.build_lexicon(words, known).collect()) == {"hello": ["a"], "ship": ["S", "I", "p"]}


def test_phonetize_keeps_order_repeats_and_empty_symbols(spark, lexicon):
    df = texts(spark, "Hello to you! to", "", "ship", "!!")
    assert by_id(G.phonetize_words(df, lexicon)) == ["h@loU tu ju  tu", "", "SIp", ""]
    assert by_id(G.phonetize_phonemes(df, lexicon))[0].startswith("h @ l oU t u ")


def test_transliteration_keeps_spacing_and_marks(spark, lexicon):
    df = texts(spark, "  Hello,  you!\n", "!", "a")
    assert by_id(G.transliterate_ipa(df, lexicon)) == ["  həloʊ,  ju!\n", "!", "ə"]
    out = G.translate_corpus(df, lexicon)
    assert by_id(out, "original_text") == ["  Hello,  you!\n", "!", "a"]


def test_task_fields(spark, lexicon):
    df = spark.createDataFrame([(7, "hello", "to you", 1)], "idx long, sentence1 string, sentence2 string, label int")
    assert [tuple(r) for r in PC.translate_task_fields(df, "rte", lexicon).collect()] == [(7, "həloʊ", "tu ju", 1)]
    with pytest.raises(ValueError):
        PC.translate_task_fields(df, "nothing", lexicon)


def test_endings(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["x", "b", "c"]), (["c"], ["c"]), ([], ["c"])], "a array<string>, b array<string>")
    rows = df.select(P.phonetic_ending(F.col("a")).alias("e"), P.is_rhyming(F.col("a"), F.col("b")).alias("r")).collect()
    assert [(r["e"], r["r"]) for r in rows] == [(["b", "c"], True), (["c"], False), ([], False)]


def test_rhyme_and_last_word_tasks(spark):
    verses = spark.createDataFrame(
        [(10, "the light"), (20, "a night"), (30, "   "), (40, "my dog"), (50, "so bright")], "verse_no long, text string"
    )
    lexicon = G.build_lexicon(spark.createDataFrame([("light",)], "word string"))
    rows = PT.rhyme_pair_rows(verses, lexicon).orderBy("id").collect()
    assert [(r["id"], r["sentence1"], r["sentence2"], r["label"]) for r in rows if r["label"] == 1] == [
        (0, "the light", "a night", 1), (2, "my dog", "my dog", 1)
    ]
    assert [(r["id"], r["sentence1"]) for r in rows if r["label"] == 0] == [(1, "the light"), (3, "my dog")]
    task = PT.build_last_word_task(PT.rhyme_pair_rows(verses, lexicon))
    assert sorted(r["label"] for r in task.collect()) == ["dog", "light"]


def test_language_filter(spark):
    rows = [(1, "the cat is on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, "the dog is in the house", "en")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profile = L.profile_table(labelled, ["en", "fr"])
    df = texts(spark, "the house", "la table", "zzz", "")
    assert by_id(L.filter_language(df, profile)) == ["the house"]


def test_inventory_counts_repeats():
    assert len(P.XSAMPA_INVENTORY) - len(set(P.XSAMPA_INVENTORY)) == 6


def test_prepare_stages_differ(spark):
    rows = [(1, "Hello THE http://x.y day", "en"), (2, "hello the http://x.z day", "en"), (3, "le jour est la", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profile = L.profile_table(docs, ["en", "fr"])
    first = PC.clean_corpus(docs.select("doc_id", "text"), profile)
    assert first.count() == 2
    wiki = PC.prepare_wikitext(docs.select("doc_id", "text"), profile)
    # Chunking puts a space after "http", so the URL rule has nothing to remove any more.
    chunk = " ".join(re.findall(r"\w+|[^\s\w]+", rows[0][1])).lower()
    assert re.sub(r"http\S+", "", chunk) == chunk == "hello the http :// x . y day"
    assert [r["text"] for r in wiki.orderBy("doc_id", "chunk_no").collect()] == ["hello the http : x . y day", "hello the http : x . z day"]


def test_held_profile_equals_the_join(spark, monkeypatch):
    rows = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat is on the mat", "en"), ("le chat est sur le tapis", "fr"), ("the dog", "en"), ("le chien", "fr")])], "doc_id long, text string, lang string")
    profile = L.profile_table(rows, ["en", "fr"])
    probe = texts(spark, "the cat", "le chat", "zzz", "", None, "the le", "le le the chien")
    held = sorted(tuple(r) for r in L.detect_language(probe, profile, ["en", "fr"]).collect())
    kept = by_id(L.filter_language(probe, profile))
    monkeypatch.setattr(L, "hold_profile", lambda *_: None)
    assert held == sorted(tuple(r) for r in L.detect_language(probe, profile, ["en", "fr"]).collect())
    assert kept == by_id(L.filter_language(probe, profile)) == ["the cat"]


def test_verses_are_keyed_by_document_and_line(spark):
    from phonolake.registry.base import joint_key

    rows = spark.createDataFrame([(1, 100_000, "so bright"), (2, 0, "a night"), (1, 7, "the light")], "doc_id long, line_no int, text string")
    lexicon = G.build_lexicon(rows.select(F.lower(F.element_at(F.split("text", " "), -1)).alias("word")))
    pairs = PT.rhyme_pair_rows(rows, lexicon, key=["doc_id", "line_no"]).filter("label = 1").orderBy("id")
    assert [tuple(r)[1:3] for r in pairs.collect()] == [("the light", "so bright"), ("a night", "the light")]
    assert rows.select(joint_key("doc_id", "line_no").alias("k")).distinct().count() == 3


def test_a_lexicon_beyond_the_tasks_writes_no_tokens(spark, lexicon, capsys):
    """Rows are shuffled once by chunk; only words of a chunk are joined, and nothing is put together by position."""
    base = texts(spark, "Hello, to YOU a you", "", None, "a-b ... x", "zz Hello" * 50)
    df = base.unionByName(base).withColumn("place", F.create_map(F.lit("a"), "doc_id"))
    out = G.transcribe(df, lexicon, most_bytes=5)
    out.explain()
    plan = capsys.readouterr().out
    assert "FlatMapCoGroupsInArrow" in plan and "ExistingRDD" in plan and "posexplode" not in plan and plan.count("Join") == 1
    want = {r.doc_id: r.text for r in G.transcribe_joined(base, lexicon).collect()}
    assert sorted((r.doc_id, r.text, r.place) for r in out.collect()) == sorted([(i, t, {"a": i}) for i, t in want.items()] * 2)


def test_chunks_meet_their_own_words(spark):
    """Two columns, many chunks, words that come in several batches of a chunk."""
    from phonolake.operators import held as H

    rows = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(i % 9)), f"w{i} w{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, one string, two string")
    table = spark.createDataFrame([(f"w{i}", f"s{i}") for i in range(0, 300, 2)], "_word string, sound string")
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    out = H.look_up_dealt(df, [split("one"), split("two")], table, "sound", ["a", "b"], chunk_bytes=200)
    said = lambda t: [None if int(w[1:]) % 2 else f"s{w[1:]}" for w in t.split()]
    assert sorted((r.doc_id, r.a, r.b) for r in out.collect()) == [(i, said(a), said(b)) for i, a, b in rows]
