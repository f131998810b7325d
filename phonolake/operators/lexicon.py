"""Transcription: distinct words to a lexicon table, and lexicon joins back onto texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.functions import phonetic as P
from phonolake.functions import text as X
from phonolake.operators.cleaning import lookup
from phonolake.operators.held import MOST_BYTES, Held, look_up, look_up_dealt, send, written
from phonolake.operators.held import hold as hold


def joined(phonemes):
    return F.array_join(phonemes, "")


def spaced(phonemes):
    return F.array_join(phonemes, " ")


def ipa(phonemes):
    return F.array_join(P.to_ipa(phonemes), "")


def one_pronunciation(pronunciations: DataFrame) -> DataFrame:
    """One entry per lower-cased word, so that a join can never multiply rows."""
    return pronunciations.groupBy(F.lower("word").alias("word")).agg(F.min("phonemes").alias("phonemes"))


def build_lexicon(words: DataFrame, pronunciations: DataFrame | None = None, rules: P.Rules | None = None) -> DataFrame:
    """``(word, phonemes)`` for each distinct lower-cased word.

    Known pronunciations win; the spelling rules, the built-in ones or a table's, cover the rest. Only distinct words are
    transcribed, however often they occur.
    """
    distinct = words.select(F.lower("word").alias("word")).distinct()
    by_rule = P.apply_grapheme_rules(F.col("word"), rules)
    if pronunciations is None:
        return distinct.select("word", by_rule.alias("phonemes"))
    known = one_pronunciation(pronunciations)
    return lookup(distinct, known, ["word"]).select("word", F.coalesce("phonemes", by_rule).alias("phonemes"))


def corpus_words(df: DataFrame, columns: Sequence[str] = ("text",), splitter=X.split_words) -> DataFrame:
    """Distinct lower-cased words of the text columns."""
    parts = [splitter(F.lower(F.col(c))) for c in columns]
    words = parts[0] if len(parts) == 1 else F.concat(*parts)
    return df.select(F.explode(words).alias("word")).distinct()


def lexicon_lookup(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Left N:1 lookup by lower-cased word."""
    table = lexicon.select(F.col("word").alias("_key"), "phonemes")
    keyed = words.withColumn("_key", F.lower("word"))
    return lookup(keyed, table, ["_key"]).drop("_key")


def transcribe(
    df: DataFrame,
    lexicon: DataFrame,
    fields: Sequence[str] = ("text",),
    id_col: str | Sequence[str] = "doc_id",
    splitter=X.split_words,
    render=joined,
    glue: str = " ",
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """Replace the text fields by their transcription, keeping all other columns.

    Tasks hold the lexicon and look words up inside the row: nothing is shuffled, no id is needed, and the rows may be
    a stream. With a lexicon above ``most_bytes`` rows are dealt into chunks, and only the distinct words of a
    chunk are joined (:func:`held.look_up_dealt`); on a stream words are joined by :func:`transcribe_joined`.
    """
    sounds = written(lexicon.select("word", render(F.col("phonemes")).alias("sound")), ["sound"])
    held = send(sounds, ["sound"], most_bytes, most_parts=1)
    if held is not None:
        return transcribe_held(df, held, fields, splitter, render, glue)
    if df.isStreaming:
        return transcribe_joined(df, lexicon, fields, id_col, splitter, render, glue)
    words = {name: splitter(F.coalesce(F.col(name), F.lit(""))) for name in fields}
    out = [f"_sounds_{i}" for i, _ in enumerate(fields)]
    rows = look_up_dealt(df, [F.transform(w, F.lower) for w in words.values()], sounds, "sound", out)
    for (name, own), found in zip(words.items(), out, strict=True):
        rows = rows.withColumn(name, _spoken(own, F.col(found), render, glue))
    return rows.select(*df.columns)


def _spoken(words: Column, sounds: Column, render, glue: str) -> Column:
    """The text of the sounds; words without one are spelled out by the rules."""

    def sound(pair):
        spelled = F.coalesce(pair["sound"], render(P.apply_grapheme_rules(pair["word"])))
        if glue == "":  # alternating words and gaps: gaps stay as they are
            return F.when(pair["word"].rlike(rf"^[{X.WORD_CHARS}]"), spelled).otherwise(pair["word"])
        return spelled

    return F.array_join(F.transform(F.arrays_zip(words.alias("word"), sounds.alias("sound")), sound), glue)


def transcribe_held(df: DataFrame, held: Held, fields: Sequence[str] = ("text",), splitter=X.split_words, render=joined, glue: str = " ") -> DataFrame:
    """Transcription by a held table of rendered sounds; words that it lacks are spelled out by the rules."""
    rows = df
    for name in fields:
        words = splitter(F.coalesce(F.col(name), F.lit("")))
        rows = look_up(rows, F.transform(words, F.lower), held, "sound", "_sounds")
        rows = rows.withColumn(name, _spoken(words, F.col("_sounds"), render, glue)).drop("_sounds")
    return rows.select(*df.columns)


def transcribe_joined(
    df: DataFrame,
    lexicon: DataFrame,
    fields: Sequence[str] = ("text",),
    id_col: str | Sequence[str] = "doc_id",
    splitter=X.split_words,
    render=joined,
    glue: str = " ",
) -> DataFrame:
    """As ``transcribe`` for a lexicon of any size: words are exploded, joined and put together again by id."""
    keys = [id_col] if isinstance(id_col, str) else list(id_col)
    base = df.repartition(*keys)
    stacked = base.select(
        *keys,
        F.posexplode(F.array(*[F.coalesce(F.col(f), F.lit("")) for f in fields])).alias("_field", "_text"),
    )
    words = stacked.select(
        *keys, "_field", F.posexplode(splitter(F.col("_text"))).alias("_pos", "word")
    )
    sound = render(F.coalesce("phonemes", P.apply_grapheme_rules(F.col("word"))))
    if glue == "":  # alternating words and gaps: gaps stay as they are
        sound = F.when(F.col("word").rlike(rf"^[{X.WORD_CHARS}]"), sound).otherwise(F.col("word"))
    sounded = lexicon_lookup(words, lexicon).select(*keys, "_field", "_pos", sound.alias("_sound"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_sound")))
    texts = (
        sounded.groupBy(*keys, "_field")
        .agg(F.array_join(F.transform(ordered, lambda s: s["_sound"]), glue).alias("_text"))
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("_field") == i, F.col("_text"))).alias(f"_t{i}") for i, _ in enumerate(fields)])
    )
    back = base.join(texts, keys, "left")
    for i, name in enumerate(fields):
        back = back.withColumn(name, F.coalesce(F.col(f"_t{i}"), F.lit("")))
    return back.select(*df.columns)


def phonetize_words(df, lexicon, **options):
    """Words and punctuation runs, symbols concatenated per word, words joined by spaces."""
    return transcribe(df, lexicon, splitter=X.split_words, **options)


def phonetize_whitespace(df, lexicon, **options):
    return transcribe(df, lexicon, splitter=X.whitespace_words, **options)


def phonetize_phonemes(df, lexicon, **options):
    """Every phoneme is a word of the output text."""
    return transcribe(df, lexicon, splitter=X.whitespace_words, render=spaced, **options)


def transliterate_ipa(df, lexicon, **options):
    """IPA transcription that keeps punctuation and spacing."""
    return transcribe(df, lexicon, splitter=X.split_words_and_gaps, render=ipa, glue="", **options)


def translate_corpus(df: DataFrame, lexicon: DataFrame, id_col: str | Sequence[str] = "doc_id") -> DataFrame:
    """``text`` becomes the transcription, ``original_text`` keeps the source."""
    return transliterate_ipa(df.withColumn("original_text", F.col("text")), lexicon, id_col=id_col)


def ending_key(phonemes: Column) -> Column:
    """Ending as one string; a word without phonemes has the empty ending."""
    return F.array_join(P.phonetic_ending(phonemes), " ")


def with_ending(df: DataFrame, lexicon: DataFrame, column: str = "text") -> DataFrame:
    """Add the last word and its phonetic ending; blank texts are dropped."""
    last = df.withColumn("word", X.last_word(F.col(column))).filter(F.col("word").isNotNull())
    sounded = lexicon_lookup(last, lexicon)
    phonemes = F.coalesce("phonemes", P.apply_grapheme_rules(F.col("word")))
    return (
        sounded.withColumn("ending", ending_key(phonemes))
        .withColumnRenamed("word", "last_word")
        .drop("phonemes")
    )


def phoneme_inventory(lexicon: DataFrame) -> DataFrame:
    """Occurrences of each phoneme in the lexicon and whether the symbol inventory knows it."""
    known = F.array(*[F.lit(s) for s in dict.fromkeys(P.XSAMPA_INVENTORY)])
    counted = (
        lexicon.select(F.explode("phonemes").alias("phoneme"))
        .groupBy("phoneme")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(
        "phoneme",
        "n",
        F.array_contains(known, F.col("phoneme")).cast("int").alias("known"),
        F.lit(len(P.XSAMPA_INVENTORY)).alias("listed"),
        F.size(known).alias("symbols"),
    )
