"""Language decision by a word profile that is itself trained on labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.functions import text as X
from phonolake.operators.cleaning import lookup
from phonolake.operators.held import Held, add_up, hold
from phonolake.session import ensure_checkpoint_dir


def _tokens(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    words = F.explode(X.split_words(F.lower(F.col("text")))).alias("token")
    return df.select(*keep, words).filter(F.col("token").rlike(r"^\p{L}"))


def profile_table(df: DataFrame, languages: Sequence[str], lang: str = "lang") -> DataFrame:
    """One row per token with an add-one log weight per language (columns ``w_<language>``).

    The token counts are checkpointed: the totals and every later use read them, not the texts.
    """
    ensure_checkpoint_dir(df.sparkSession)
    labelled = df.filter(F.col(lang).isin(list(languages)))
    counts = (
        _tokens(labelled, [lang])
        .groupBy("token")
        .agg(*[F.count_if(F.col(lang) == name).alias(f"n_{name}") for name in languages])
        .checkpoint()
    )
    totals = counts.agg(
        F.struct(
            F.count(F.lit(1)).alias("types"),
            *[F.sum(f"n_{name}").alias(f"n_{name}") for name in languages],
        ).alias("t")
    ).scalar()
    return counts.withColumn("_t", totals).select(
        "token",
        *[f"n_{name}" for name in languages],
        *[
            F.log((F.col(f"n_{name}") + 1) / (F.col(f"_t.n_{name}") + F.col("_t.types"))).alias(f"w_{name}")
            for name in languages
        ],
    )


def train_language_profile(df: DataFrame, languages: Sequence[str], lang: str = "lang") -> DataFrame:
    """The profile as a long table ``(lang, token, n, weight)``."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("lang"), F.col(f"n_{name}").alias("n"), F.col(f"w_{name}").alias("weight"))
            for name in languages
        ]
    )
    return profile_table(df, languages, lang).select("token", F.inline(entries))


def detect_language(
    df: DataFrame, profile: DataFrame, languages: Sequence[str], id_col: str | Sequence[str] = "doc_id"
) -> DataFrame:
    """``(id, detected)``; an id may have several columns. Rows without any known word get no row, ties go to nobody.

    Tasks hold the profile and add up inside the row. For a profile too large for that, scores are summed
    map-side, so only one row per document and map task is shuffled.
    """
    keys = [id_col] if isinstance(id_col, str) else list(id_col)
    held = hold_profile(profile, languages)
    if held is not None:
        return with_language(df.select(*keys, "text"), held, languages).where(F.col("_scores").isNotNull()).select(*keys, "detected")
    scored = (
        lookup(_tokens(df, keys), profile, ["token"])
        .groupBy(*keys)
        .agg(*[F.sum(f"w_{name}").alias(f"s_{name}") for name in languages])
        .filter(F.col(f"s_{languages[0]}").isNotNull())
    )
    best = _best({name: F.col(f"s_{name}") for name in languages})
    return scored.select(*keys, best.alias("detected"))


def _best(scores: dict[str, Column]) -> Column:
    """The language with the highest score; null where two share it."""
    best = F.lit(None).cast("string")
    for name, score in scores.items():
        wins = F.lit(True)
        for other, against in scores.items():
            if other != name:
                wins = wins & (score > against)
        best = F.when(wins, F.lit(name)).otherwise(best)
    return best


def hold_profile(profile: DataFrame, languages: Sequence[str]) -> Held | None:
    """The profile as a table that tasks hold, or None if it is too large."""
    return hold(profile, [f"w_{name}" for name in languages], word="token")


def with_language(df: DataFrame, held: Held, languages: Sequence[str]) -> DataFrame:
    """Add ``_scores`` and ``detected`` (null without a known word, or where two languages share the highest score)."""
    words = F.filter(X.split_words(F.lower(F.col("text"))), lambda w: w.rlike(r"^\p{L}"))
    scored = add_up(df, words, held, "_scores")
    return scored.withColumn("detected", _best({name: F.col("_scores")[k] for k, name in enumerate(languages)}))


def filter_language(
    df: DataFrame,
    profile: DataFrame,
    keep: str = "en",
    languages: Sequence[str] = ("en", "fr"),
    id_col: str | Sequence[str] = "doc_id",
) -> DataFrame:
    """Rows detected as ``keep`` among ``languages``, by a held profile where it fits; then the rows may be a stream."""
    held = hold_profile(profile, languages)
    if held is not None and not (df.isStreaming and len(held.parts) > 1):
        return with_language(df, held, languages).where(F.col("detected") == keep).select(*df.columns)
    keys = [id_col] if isinstance(id_col, str) else list(id_col)
    accepted = detect_language(df, profile, languages, id_col).filter(F.col("detected") == keep)
    return df.join(accepted.select(*keys), keys, "left_semi")
