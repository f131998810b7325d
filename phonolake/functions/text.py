"""Text expressions: cleaning, word splitting, chunking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that agree with Python's \w and \s for every code point,
# in Java and RE2 syntax alike. Spark's own \w is ASCII only.
WORD_CHARS = r"\p{L}\p{N}_"
SPACE_CHARS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
WORDS_AND_RUNS = rf"[{WORD_CHARS}]+|[^{SPACE_CHARS}{WORD_CHARS}]+"
WORDS_AND_MARKS = rf"[{WORD_CHARS}]+|[^{SPACE_CHARS}{WORD_CHARS}]"
WORDS_AND_GAPS = rf"[{WORD_CHARS}]+|[^{WORD_CHARS}]+"
NON_SPACE = rf"[^{SPACE_CHARS}]+"
KEPT_CHARS = r"""[^a-zA-Z0-9,.!?;:'" ]+"""
# The same set for text whose whitespace is collapsed; two plain ranges match several times faster.
DROPPED_CHARS = r"[^ -~]+|[#$%&()*+/<=>@\[\\\]^_`{|}~\-]+"
MASK_WORD = "[MASK]"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def clean_text(text: Column, lowercase: bool = True) -> Column:
    """Lower, collapse whitespace, drop URLs, drop unusual characters, strip - in that order.

    Whitespace is collapsed before the removals, so inner double spaces can remain.
    """
    out = F.lower(text) if lowercase else text
    out = F.regexp_replace(out, rf"[{SPACE_CHARS}]+", " ")
    out = F.regexp_replace(out, r"http[^ ]+", "")
    out = F.regexp_replace(out, DROPPED_CHARS, "")
    return F.trim(out)


def normalize_poem_line(line: Column) -> Column:
    """Poem order: collapse whitespace, drop punctuation, then the URL rule; case is kept."""
    out = F.regexp_replace(line, rf"[{SPACE_CHARS}]+", " ")
    out = F.regexp_replace(out, r"[^a-zA-Z0-9 ]", "")
    out = F.regexp_replace(out, r"http[^ ]+", "")
    return F.trim(out)


def split_words(text: Column) -> Column:
    """Words and runs of punctuation."""
    return _all(text, WORDS_AND_RUNS)


def split_words_single_punct(text: Column) -> Column:
    """Words and single punctuation marks."""
    return _all(text, WORDS_AND_MARKS)


def split_words_and_gaps(text: Column) -> Column:
    """Alternating words and everything between them; joining gives the text back."""
    return _all(text, WORDS_AND_GAPS)


def whitespace_words(text: Column) -> Column:
    """Words between whitespace, without empty ones."""
    return _all(text, NON_SPACE)


def chunks(words: Column, size: int) -> Column:
    """Array of chunks of ``size`` words joined by spaces; empty for an empty word array."""
    starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(size))
    joined = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))
    return F.when(F.size(words) > 0, joined).otherwise(F.array().cast("array<string>"))


def num_words(text: Column) -> Column:
    return F.size(whitespace_words(text))


def last_word(text: Column) -> Column:
    """Last whitespace word, null for a blank text."""
    return F.try_element_at(whitespace_words(text), F.lit(-1))


def mask_last_word(text: Column) -> Column:
    words = whitespace_words(text)
    head = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.when(F.size(words) > 0, F.array_join(F.concat(head, F.array(F.lit(MASK_WORD))), " "))


def text_hash(text: Column) -> Column:
    return F.md5(text)


def split_delimited(cell: Column) -> Column:
    """Split at ``;``, strip the parts, then split at ``|`` - inner parts keep their spaces."""
    parts = F.transform(F.split(cell, ";"), lambda part: F.trim(part))
    return F.flatten(F.transform(parts, lambda part: F.split(part, r"\|")))


def is_capitalized(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def word_spans(text: Column) -> Column:
    """Array of ``(word, start)`` with zero-based character starts of ``split_words`` output.

    Works on the alternation of words and whitespace, so every character is counted once.
    """
    pieces = _all(text, rf"{WORDS_AND_RUNS}|[{SPACE_CHARS}]+")
    seed = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<word:string,start:int>>").alias("out"),
    )

    def step(state: Column, piece: Column) -> Column:
        found = F.array(F.struct(piece.alias("word"), state["at"].alias("start")))
        return F.struct(
            (state["at"] + F.length(piece)).alias("at"),
            F.when(piece.rlike(rf"^[{SPACE_CHARS}]"), state["out"])
            .otherwise(F.concat(state["out"], found))
            .alias("out"),
        )

    return F.aggregate(pieces, seed, step, lambda state: state["out"])
