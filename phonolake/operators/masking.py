"""Masked-language-model examples as array expressions; every draw hangs on (row id, position)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from phonolake.functions.hashing import hash_below, hash_unit
from phonolake.operators.encoding import IGNORED, pad_to

KEEP, MASK, RANDOM, SAME = 0, 1, 2, 3


def _kind(draw: Column) -> Column:
    """80 % mask, 10 % random token, 10 % unchanged."""
    return F.when(draw < 0.8, F.lit(MASK)).when(draw < 0.9, F.lit(RANDOM)).otherwise(F.lit(SAME))


def _replace(ids: Column, kinds: Column, row_id: Column, seed, mask_id: int, low: int, vocab_size: int) -> Column:
    pairs = F.zip_with(ids, kinds, lambda x, k: F.struct(x.alias("x"), k.alias("k")))

    def one(p: Column, i: Column) -> Column:
        drawn = hash_below(vocab_size - low, f"{seed}:token", row_id, i) + low
        return F.when(p["k"] == MASK, F.lit(mask_id)).when(p["k"] == RANDOM, drawn.cast("int")).otherwise(p["x"])

    return F.transform(pairs, one)


def _labels(ids: Column, kinds: Column) -> Column:
    return F.zip_with(ids, kinds, lambda x, k: F.when(k != KEEP, x).otherwise(F.lit(IGNORED)))


def mlm_mask(
    ids: Column,
    row_id: Column,
    special: Mapping[str, int],
    vocab_size: int,
    seed: int | str = 42,
    probability: float = 0.15,
) -> Column:
    """Struct ``input_ids, labels``: each non-special position is masked with the probability."""
    fixed = F.array(*[F.lit(i) for i in special.values()])

    def kind(x: Column, i: Column) -> Column:
        chosen = ~F.array_contains(fixed, x) & (hash_unit(f"{seed}:pick", row_id, i) < probability)
        return F.when(chosen, _kind(hash_unit(f"{seed}:kind", row_id, i))).otherwise(F.lit(KEEP))

    kinds = F.transform(ids, kind)
    return F.struct(
        _replace(ids, kinds, row_id, seed, special["[MASK]"], 0, vocab_size).alias("input_ids"),
        _labels(ids, kinds).alias("labels"),
    )


def aligned_word_kinds(
    normal: Column, phonetic: Column, row_id: Column, budget: int, seed: int | str = 42, probability: float = 0.15
) -> Column:
    """Struct ``normal, phonetic``: per-token mask kinds, the same for word i on both sides.

    max(1, floor(p * shorter word count)) word positions are drawn without replacement. Words
    have at least one token each, so only the first ``budget`` words can reach the output.
    """
    n = F.least(F.size(normal), F.size(phonetic))
    keyed = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(hash_unit(f"{seed}:word", row_id, i).alias("h"), i.alias("i")),
        )
    )
    # 0.15 * 20 must floor to 3 whatever its binary representation.
    count = F.greatest(F.floor(F.round(n * probability, 9)).cast("int"), F.lit(1))
    chosen = F.transform(F.slice(keyed, F.lit(1), count), lambda s: s["i"])

    def kinds(words: Column) -> Column:
        def word(ids: Column, i: Column) -> Column:
            kind = F.when(F.array_contains(chosen, i), _kind(hash_unit(f"{seed}:kind", row_id, i)))
            return F.array_repeat(F.coalesce(kind, F.lit(KEEP)), F.size(ids))

        return F.slice(F.flatten(F.transform(F.slice(words, 1, budget), word)), 1, budget)

    return F.struct(kinds(normal).alias("normal"), kinds(phonetic).alias("phonetic"))


def bilingual_example(
    normal: Column,
    phonetic: Column,
    kinds: Column,
    row_id: Column,
    special: Mapping[str, int],
    vocab_size: int,
    max_length: int = 128,
    seed: int | str = 42,
) -> Column:
    """Struct of fixed-length ``input_ids, attention_mask, token_type_ids, labels``.

    ``[CLS] normal [SEP] phonetic [SEP]``, each side cut to max_length // 2 - 2 tokens.
    """
    budget = max_length // 2 - 2
    one = F.slice(F.flatten(F.slice(normal, 1, budget)), 1, budget)
    two = F.slice(F.flatten(F.slice(phonetic, 1, budget)), 1, budget)
    cls, sep = F.array(F.lit(special["[CLS]"])), F.array(F.lit(special["[SEP]"]))
    none = F.array(F.lit(KEEP))
    ids = F.concat(cls, one, sep, two, sep)
    marks = F.concat(none, kinds["normal"], none, kinds["phonetic"], none)
    types = F.concat(F.array_repeat(F.lit(0), F.size(one) + 2), F.array_repeat(F.lit(1), F.size(two) + 1))
    masked = _replace(ids, marks, row_id, seed, special["[MASK]"], 5, vocab_size)
    return F.struct(
        pad_to(masked, max_length, special["[PAD]"]).alias("input_ids"),
        pad_to(F.transform(ids, lambda _: F.lit(1)), max_length, 0).alias("attention_mask"),
        pad_to(types, max_length, 0).alias("token_type_ids"),
        pad_to(_labels(ids, marks), max_length, IGNORED).alias("labels"),
    )


def mask_before_sep(ids: Column, target_size: Column, special: Mapping[str, int]) -> Column:
    """Struct ``input_ids, labels``: the last ``target_size`` tokens before the first [SEP] are masked.

    A target longer than what stands before the separator masks nothing.
    """
    end = F.array_position(ids, special["[SEP]"]) - 1
    start = end - target_size
    inside = lambda i: (start >= 0) & (i >= start) & (i < end)
    return F.struct(
        F.transform(ids, lambda x, i: F.when(inside(i), F.lit(special["[MASK]"])).otherwise(x)).alias("input_ids"),
        F.transform(ids, lambda x, i: F.when(inside(i), x).otherwise(F.lit(IGNORED))).alias("labels"),
    )
