"""Text stages on a stream.

Column expressions, chunking, transcription and the language filter work row by row, so ``readStream`` frames go
through the batch code. Duplicates need state: the hashes seen within the watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.functions import text as X
from phonolake.operators import cleaning as C
from phonolake.operators import language, lexicon
from phonolake.operators.held import hold


def clean_stream(texts: DataFrame, chunk_size: int = 100) -> DataFrame:
    """Chunk, clean and drop empty rows of a streaming frame with a ``text`` column."""
    return C.filter_nonempty(C.map_text(C.chunk_words(texts, chunk_size), X.clean_text))


def transcribe_stream(texts: DataFrame, words: DataFrame, fields: Sequence[str] = ("text",), splitter=X.split_words, render=lexicon.joined, glue: str = " ") -> DataFrame:
    """Transcribe a stream by a static lexicon that tasks hold; append mode, no state.

    The lexicon is read once, when the query starts. One too large for a single part is an error.
    """
    held = hold(words.select("word", render(F.col("phonemes")).alias("sound")), ["sound"], most_parts=1)
    if held is None:
        raise ValueError("the lexicon is too large to be held by the tasks of a stream")
    return lexicon.transcribe_held(texts, held, fields, splitter, render, glue)


def filter_language_stream(texts: DataFrame, profile: DataFrame, keep: str = "en", languages: Sequence[str] = ("en", "fr")) -> DataFrame:
    """Rows of a stream in the language ``keep`` by a static profile; append mode, no state."""
    held = language.hold_profile(profile, languages)
    if held is None or len(held.parts) > 1:
        raise ValueError("the profile is too large to be held by the tasks of a stream")
    return language.with_language(texts, held, languages).where(F.col("detected") == keep).select(*texts.columns)


def dedup_stream(texts: DataFrame, time_col: str, delay: str = "1 hour", column: str = "text", scope_cols: Sequence[str] = ()) -> DataFrame:
    """Keep the first row of each text hash that arrives within the watermark.

    State holds one hash for each text seen until its row is ``delay`` behind the latest one, so it is bounded
    by the rows of that time. A copy that comes after its hash has gone counts as new; rows older than the watermark
    are dropped.
    """
    keyed = texts.withColumn("_hash", F.md5(F.col(column))).withWatermark(time_col, delay)
    return keyed.dropDuplicatesWithinWatermark(["_hash", *scope_cols]).drop("_hash")
