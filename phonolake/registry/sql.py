"""Pieces shared by the SQL oracles."""

from __future__ import annotations

from phonolake.functions import phonetic as P
from phonolake.functions import text as X
from phonolake.functions.hashing import SPAN


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def H(seed, *ids: str) -> str:
    """Hash number in [0, 1)."""
    key = ", ".join([quote(str(seed)), *[f"({i})::VARCHAR" for i in ids]])
    return f"(('0x' || substr(md5(concat_ws(':', {key})), 1, 8))::BIGINT / {SPAN}.0::DOUBLE)"


def below(n: str, seed, *ids: str) -> str:
    return f"floor({H(seed, *ids)} * ({n}))::BIGINT"


def clean(text: str, lowercase: bool = True) -> str:
    inner = f"lower({text})" if lowercase else text
    inner = f"regexp_replace({inner}, '[{X.SPACE_CHARS}]+', ' ', 'g')"
    inner = f"regexp_replace({inner}, 'http[^ ]+', '', 'g')"
    inner = f"regexp_replace({inner}, {quote(X.KEPT_CHARS)}, '', 'g')"
    return f"trim({inner})"


def words(text: str, pattern: str = X.WORDS_AND_RUNS) -> str:
    return f"regexp_extract_all({text}, {quote(pattern)})"


def marks(text: str) -> str:
    return words(text, X.WORDS_AND_MARKS)


def spaced(text: str) -> str:
    return words(text, X.NON_SPACE)


def phonemes(word: str) -> str:
    """Phoneme list of a word by the spelling rules."""
    keys = ", ".join(quote(s) for s, _ in P.RULES)
    values = ", ".join(quote(" ".join(ps)) for _, ps in P.RULES)
    pieces = f"regexp_extract_all(lower({word}), {quote(P.GRAPHEME_PATTERN)})"
    mapped = f"list_transform({pieces}, lambda g: map([{keys}], [{values}])[g])"
    return f"(CASE WHEN len({pieces}) = 0 THEN []::VARCHAR[] ELSE string_split(array_to_string({mapped}, ' '), ' ') END)"


def ipa(phoneme_list: str) -> str:
    keys = ", ".join(quote(s) for s in P.IPA)
    values = ", ".join(quote(i) for i in P.IPA.values())
    return f"list_transform({phoneme_list}, lambda p: map([{keys}], [{values}])[p])"


def joined(values: str, glue: str = "") -> str:
    return f"coalesce(array_to_string({values}, {quote(glue)}), '')"


def lexicon(source: str, text: str = "text", pattern: str = X.WORDS_AND_RUNS, name: str = "lex") -> str:
    """CTEs ending in ``lex(word, phonemes)`` over the distinct lower-cased words of a text column."""
    return f"""
    {name}_words AS (SELECT DISTINCT unnest({words(f'lower({text})', pattern)}) AS word FROM {source}),
    {name} AS (SELECT word, {phonemes('word')} AS phonemes FROM {name}_words)"""


def key(*ids: str) -> str:
    """One key out of several ids, different for different ids."""
    return f"concat_ws(':', {', '.join(ids)})"


def split_case(pos: str, n: str, test: float, validation: float) -> str:
    """Split name from the position in hash order and the row count."""
    n_test = f"ceil(round({n} * {test}, 9))"
    n_val = f"ceil(round(({n} - {n_test}) * {validation}, 9))"
    return f"CASE WHEN {pos} < {n_test} THEN 'test' WHEN {pos} < {n_test} + {n_val} THEN 'validation' ELSE 'train' END"


def hash_bits(seed, *ids: str) -> str:
    key = ", ".join([quote(str(seed)), *[f"({i})::VARCHAR" for i in ids]])
    return f"('0x' || substr(md5(concat_ws(':', {key})), 1, 8))::BIGINT"
