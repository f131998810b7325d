import random
from difflib import SequenceMatcher
from itertools import combinations

from pyspark.sql import functions as F

from phonolake.functions import text as X
from phonolake.operators import pairs as R
from phonolake.plans import tasks as PT


def keyed(spark, endings):
    return spark.createDataFrame(list(enumerate(endings)), "pos long, ending string")


def test_positive_pairs_take_the_lowest_other_row(spark):
    endings = ["a", "b", "a", "c", "b", "a", "d"]
    keys = keyed(spark, endings)
    got = dict(R.rhyme_positive_pairs(keys, keys.filter("pos % 2 = 0"), "pos").collect())
    want = {}
    for i in range(0, len(endings), 2):
        others = [j for j, e in enumerate(endings) if e == endings[i] and j != i]
        want[i] = others[0] if others else i
    assert got == want


def test_negative_pairs_are_uniform_over_other_endings(spark):
    endings = ["hot"] * 400 + ["x"] * 20 + ["y"] * 20
    keys = keyed(spark, endings)
    rows = R.rhyme_negative_pairs(keys, keys, "pos").collect()
    assert len(rows) == len(endings) and all(endings[a] != endings[b] for a, b in rows)
    from_hot = [endings[b] for a, b in rows if endings[a] == "hot"]
    assert abs(from_hot.count("x") / len(from_hot) - 0.5) < 0.1
    assert len({b for a, b in rows if endings[a] == "x"}) > 5


def test_single_ending_gives_no_negative(spark):
    keys = keyed(spark, ["a"] * 5)
    assert R.rhyme_negative_pairs(keys, keys, "pos").count() == 0


def brute_near(words, sounds):
    return {
        (a, b) for a, b in combinations(words, 2)
        if len(a) == len(b) and sounds[a] != sounds[b] and SequenceMatcher(None, a, b).ratio() > 0.8
    }


def test_near_spelling_equals_brute_force(spark):
    draw = random.Random(3)
    words = []
    for n in (5, 6, 8, 10, 11, 13, 15, 16, 18, 20, 21, 24, 26):
        for _ in range(6):
            base = [draw.choice("abcde") for _ in range(n)]
            words.append("".join(base))
            for _ in range(5):
                edited = list(base)
                for _ in range(draw.randint(1, max(1, n // 5))):
                    kind = draw.random()
                    at = draw.randrange(len(edited))
                    if kind < 0.5:
                        edited[at] = draw.choice("abcde")
                    else:
                        edited.insert(draw.randrange(len(edited)), edited.pop(at))
                words.append("".join(edited))
    words = list(dict.fromkeys(words))
    draw.shuffle(words)
    sounds = {w: w if i % 4 else "same" for i, w in enumerate(words)}
    df = spark.createDataFrame([(i, w, sounds[w]) for i, w in enumerate(words)], "word_id long, word string, sound string")
    got = [tuple(r) for r in R.near_spelling_pairs(df).collect()]
    want = brute_near(words, sounds)
    assert len(want) > 200 and len(got) == len(set(got)) and set(got) == want


def test_similarity_thresholds(spark):
    words = ["abcde", "abcdf", "abcdef", "abcdeg", "abcdefghij", "abcdefghix", "abcdefghyx"]
    df = spark.createDataFrame([(i, w, w) for i, w in enumerate(words)], "word_id long, word string, sound string")
    got = {tuple(r) for r in R.near_spelling_pairs(df).collect()}
    assert got == {("abcdef", "abcdeg"), ("abcdefghij", "abcdefghix"), ("abcdefghix", "abcdefghyx")}


def test_group_all_pairs(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, [])], "g long, words array<string>")
    assert {tuple(r) for r in R.group_all_pairs(df, "g").collect()} == {(1, "a", "b"), (1, "a", "c"), (1, "b", "c")}


def test_unrelated_pairs_avoid_relations_even_when_dense(spark):
    terms = [f"t{i}" for i in range(12)]
    related = {(a, b) for a in terms[:3] for b in terms[:-2]} | {(t, "outside") for t in terms}
    edges = spark.createDataFrame(sorted(related), "term string, related_term string")
    rows = R.sample_unrelated_pairs(edges).collect()
    assert len(rows) == 24 and not {(r["term"], r["unrelated_term"]) for r in rows} & related
    for t in terms:
        mine = [r["unrelated_term"] for r in rows if r["term"] == t]
        assert len(set(mine)) == 2
    assert {r["unrelated_term"] for r in rows if r["term"] == "t0"} == {"t10", "t11"}


def test_unrelated_pairs_are_spread_evenly(spark):
    edges = spark.createDataFrame([(f"t{i:03}", f"t{i + 1:03}") for i in range(400)], "term string, related_term string")
    drawn = [r["unrelated_term"] for r in R.sample_unrelated_pairs(edges).collect()]
    assert len(drawn) == 800 and len(set(drawn)) > 300


def test_mispair_negatives_never_reuse_one_pair(spark):
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(200)], "word1 string, word2 string")
    rows = R.mispair_negatives(pairs).collect()
    assert len(rows) == 200 and all(r["word1"][1:] != r["word2"][1:] for r in rows)


def test_mispair_negatives_compute_each_hash_once(spark, capsys):
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(20)], "word1 string, word2 string")
    R.mispair_negatives(pairs).explain()
    plan = capsys.readouterr().out
    # the two draws; the order is a column of the written rows
    assert plan.count("md5(") == 2


def test_a_set_is_kept_exactly_when_no_earlier_kept_set_mentions_its_lemma(spark):
    draw = random.Random(11)
    rows = []
    for i in range(150):
        lemma = None if draw.random() < 0.05 else draw.choice("AB" if draw.random() < 0.05 else "abcdefghijklmnopqrstuvwxyz") + str(draw.randint(0, 3))
        rows.append((i, lemma, [draw.choice("abcdefghijklmnopqrstuvwxyz") + str(draw.randint(0, 3)) for _ in range(draw.randint(1, 3))]))
    rows += [(150 + i, f"chain{i}", [f"chain{i + 1}"]) for i in range(8)]
    df = spark.createDataFrame(rows, "row_id long, lemma string, members array<string>").repartition(3)
    kept = {r["row_id"] for r in R.greedy_disjoint_sets(df).collect()}
    mentions = lambda row, word: word in row[2] or word == row[1]
    for row_id, lemma, _ in rows:
        blocked = lemma is not None and (lemma[0].isupper() or any(mentions(r, lemma) for r in rows[:row_id] if r[0] in kept))
        assert (row_id in kept) != blocked


def test_a_chain_of_many_lemmas_alternates(spark):
    rows = [(i, f"c{i}", [f"c{i + 1}"]) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, lemma string, members array<string>")
    assert sorted(r["row_id"] for r in R.greedy_disjoint_sets(df).collect()) == list(range(0, 30, 2))


def test_synonym_task(spark):
    rows = [(0, "big", "large; huge|vast"), (1, "large", "big"), (2, "Paris", "city"), (3, None, "x;y"), (4, "tiny", None)]
    out = PT.build_synonym_task(spark.createDataFrame(rows, "row_id long, lemma string, synonyms string")).collect()
    positives = {frozenset((r["word1"], r["word2"])) for r in out if r["label"] == 1}
    want = {frozenset(p) for p in combinations(["big", "large", "huge", "vast"], 2)} | {frozenset("xy"), frozenset(["tiny", ""])}
    assert positives == want and sum(r["label"] == 0 for r in out) == len(want)


def test_label_index_follows_first_appearance(spark):
    df = spark.createDataFrame([(3, "x"), (1, "z"), (2, "x"), (5, "a")], "id long, Meter string")
    assert dict(R.label_index(df, "Meter", "id").collect()) == {"z": 0, "x": 1, "a": 2}


def test_homophone_task_keeps_all_negatives(spark):
    words = ["rough", "ruff", "kitten", "mitten", "well-known", "bitten"]
    df = spark.createDataFrame(list(enumerate(words)), "word_id long, word string")
    lexicon = spark.createDataFrame([(w, list(w)) for w in words], "word string, phonemes array<string>")
    groups = spark.createDataFrame([(1, ["rough", "ruff"])], "group_id long, words array<string>")
    rows = PT.build_homophone_task(df, groups, lexicon).collect()
    assert {(r["word1"], r["word2"], r["label"]) for r in rows} == {
        ("rough", "ruff", 1), ("kitten", "mitten", 0), ("kitten", "bitten", 0), ("mitten", "bitten", 0)
    }


def test_positional_alignment_stops_at_the_shorter_text(spark):
    df = spark.createDataFrame([(1, "a b c", "x y"), (2, "", "x")], "doc_id long, a string, b string")
    got = R.positional_word_align(df, X.split_words(F.col("a")), X.split_words(F.col("b")))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, "a", "x"), (1, 1, "b", "y")]


def test_synonym_rows_take_all_words(spark, tmp_path):
    from phonolake.registry import tables

    line = " ".join(f"w{i}" for i in range(50))
    names = ["one", "a b c", line, "P q  r s", "", None]
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    rows = tables.synonym_rows(spark, str(tmp_path)).select("lemma", "synonyms", X.split_delimited(F.col("synonyms")).alias("members"))
    got = {r.lemma: (r.synonyms, r.members) for r in rows.collect()}
    assert got["one"] == (None, None) and got[None] == (None, None)
    assert got["a"] == ("b; c", ["b", "c"]) and got["p"][0] == "q; r|s"
    assert got["w0"][1] == line.split()[1:]


def test_sets_keyed_by_a_pair_keep_apart(spark):
    from phonolake.operators import pairs as R

    rows = [((1, 100_000), "apple", ["b"]), ((2, 0), "apple", ["c"]), ((2, 1), "pear", ["d"])]
    df = spark.createDataFrame(rows, "row_id struct<doc_id: long, line_no: long>, lemma string, members array<string>")
    got = R.greedy_disjoint_sets(df).collect()
    assert sorted((*r.row_id, r.lemma) for r in got) == [(1, 100_000, "apple"), (2, 1, "pear")]


def test_the_split_does_not_compare_words_again(spark, capsys):
    """The pairs are written before the split, which reads them twice."""
    from phonolake.plans import tasks

    words = spark.createDataFrame([(1, "abcdefgh"), (2, "abcdefgi"), (3, "x")], "word_id long, word string")
    lexicon = spark.createDataFrame([("abcdefgh", ["a"]), ("abcdefgi", ["b"]), ("x", ["x"])], "word string, phonemes array<string>")
    groups = spark.createDataFrame([(1, ["p", "q"])], "group_id long, words array<string>")
    out = tasks.build_homophone_task(words, groups, lexicon)
    assert sorted((r.word1, r.word2, r.label) for r in out.collect()) == [("abcdefgh", "abcdefgi", 0), ("p", "q", 1)]
    out.explain()
    assert "Python" not in capsys.readouterr().out
