"""Labelled pair data sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.functions import text as X
from phonolake.operators import cleaning as C
from phonolake.operators import lexicon as G
from phonolake.operators import pairs as R
from phonolake.operators import sampling as S
from phonolake.operators.positions import ordered_index, with_hash_bits
from phonolake.session import ensure_checkpoint_dir


def rhyme_pair_rows(
    verses: DataFrame, lexicon: DataFrame, seed: int | str = 42, key: Sequence[str] = ("verse_no",)
) -> DataFrame:
    """``verses`` (the key columns and text) to ``id, sentence1, sentence2, label``.

    Anchors are the rows at even positions; each gives one rhyming pair (possibly with itself)
    and one pair from a different ending. The keys of the verses feed five joins, so they are
    checkpointed once; texts join at the end.
    """
    ensure_checkpoint_dir(verses.sparkSession)
    ended = G.with_ending(verses.select(*key, "text"), lexicon).select(*key, "ending")
    keys = ordered_index(ended, key, "pos").checkpoint()
    anchors = keys.filter(F.col("pos") % 2 == 0)
    both = (
        R.rhyme_positive_pairs(keys, anchors, "pos").withColumn("label", F.lit(1))
        .unionByName(R.rhyme_negative_pairs(keys, anchors, "pos", seed).withColumn("label", F.lit(0)))
    )
    numbered = R.pair_row_ids(both.withColumn("_no", F.expr("anchor div 2")), "_no")
    texts = keys.join(verses.select(*key, "text"), list(key)).select("pos", "text")
    full = numbered.join(
        texts.select(F.col("pos").alias("anchor"), F.col("text").alias("sentence1")), "anchor"
    ).join(texts.select(F.col("pos").alias("partner"), F.col("text").alias("sentence2")), "partner")
    return full.select("id", "sentence1", "sentence2", "label")


def build_rhyme_pairs(
    verses: DataFrame, lexicon: DataFrame, seed: int | str = 42, key: Sequence[str] = ("verse_no",)
) -> DataFrame:
    """Rhyme pairs with a split column."""
    return S.train_val_test_split(rhyme_pair_rows(verses, lexicon, seed, key), ["id"], 0.2, 0.1, seed)


def build_last_word_task(
    pairs: DataFrame, lexicon: DataFrame | None = None, id_col: str = "id", seed: int | str = 42
) -> DataFrame:
    """Rhyming pairs with the last word of the first sentence as the string label."""
    rhymes = C.filter_equals(pairs, ["label"], [1]).select(id_col, "sentence1", "sentence2")
    task = rhymes.withColumn("label", X.last_word(F.col("sentence1"))).filter(F.col("label").isNotNull())
    if lexicon is not None:
        task = G.phonetize_whitespace(task, lexicon, fields=["sentence1", "sentence2", "label"], id_col=id_col)
    return S.train_val_test_split(task, [id_col], 0.1, 0.1, seed)


def build_homophone_task(
    words: DataFrame, groups: DataFrame, lexicon: DataFrame, seed: int | str = 42
) -> DataFrame:
    """``words`` (word_id, word) and ``groups`` (group_id, words) to labelled word pairs.

    Positives are all pairs inside each homophone list; negatives are words that look alike and
    sound different. All negatives are kept.
    """
    ensure_checkpoint_dir(words.sparkSession)
    plain = C.filter_plain_words(words)
    sounds = G.lexicon_lookup(plain, lexicon).select(
        "word_id", "word", F.array_join("phonemes", "").alias("sound")
    )
    positives = R.group_all_pairs(groups, "group_id")
    # the split reads the pairs more than once
    ids = ["word1", "word2", "label"]
    pairs = with_hash_bits(C.concat_labelled_pairs(positives, R.near_spelling_pairs(sounds)), seed, ids).checkpoint()
    return S.train_val_test_split(pairs, ids, 0.1, 0.1, seed, hashed=True)


def build_etymology_task(
    edges: DataFrame, languages: Sequence[str] = ("en",), seed: int | str = 42
) -> DataFrame:
    """Related pairs (label 1) and two unrelated draws per term (label 0), cleaned and split."""
    ensure_checkpoint_dir(edges.sparkSession)
    own = R.adjacency_pairs(C.filter_equals(edges, ["lang", "related_lang"], languages)).checkpoint()
    positives = own.select(F.col("term").alias("word1"), F.col("related_term").alias("word2"))
    negatives = R.sample_unrelated_pairs(own, seed).select(
        F.col("term").alias("word1"), F.col("unrelated_term").alias("word2")
    )
    pairs = C.concat_labelled_pairs(positives, negatives).distinct()
    pairs = C.drop_blank_rows(pairs, ["word1", "word2"]).checkpoint()
    return S.train_val_test_split(pairs, ["word1", "word2", "label"], 0.2, 0.1, seed)


def build_synonym_task(rows: DataFrame, seed: int | str = 42) -> DataFrame:
    """``rows`` (row_id, lemma, synonyms) to labelled pairs; the set selection iterates.

    A set's members are the lemma and its synonyms, in that order, without repeats.
    """
    cell = F.coalesce("synonyms", F.lit(""))
    listed = rows.select("row_id", "lemma", F.array_distinct(X.split_delimited(cell)).alias("members"))
    kept = R.greedy_disjoint_sets(listed)
    own = F.when(F.col("lemma").isNotNull(), F.array("lemma")).otherwise(F.array().cast("array<string>"))
    sets = kept.select("row_id", F.array_distinct(F.concat(own, "members")).alias("words"))
    positives = R.group_all_pairs(sets, "row_id").select("row_id", "word1", "word2")
    pairs = C.concat_labelled_pairs(positives, R.mispair_negatives(positives, seed))
    return S.train_val_test_split(pairs, ["word1", "word2", "label"], 0.2, 0.1, seed)


def build_meter_task(
    verses: DataFrame, lexicon: DataFrame | None = None, id_col: str = "id", seed: int | str = 42, order_col: str | None = None
) -> DataFrame:
    """Label by order of first appearance (of ``order_col``, by default the id), split, oversample the training rows."""
    labels = R.label_index(verses, "Meter", order_col or id_col)
    labelled = C.lookup(verses.select(id_col, "Verse", "Meter"), labels, ["Meter"], "inner")
    if lexicon is not None:
        labelled = G.phonetize_whitespace(
            labelled.withColumn("Original", F.col("Verse")), lexicon, fields=["Verse"], id_col=id_col
        )
    split = S.train_val_test_split(labelled, [id_col], 0.2, 0.2, seed)
    train = S.oversample_classes(split.filter("split = 'train'"))
    held_out = split.filter("split != 'train'").withColumn("copy", F.lit(1))
    return train.unionByName(held_out)
