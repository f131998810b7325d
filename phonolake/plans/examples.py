"""Training examples from tokenized texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.operators import encoding as E
from phonolake.operators import masking as M


def flat(column: str):
    return F.flatten(F.col(column))


def single_examples(df: DataFrame, table: DataFrame, special: Mapping[str, int], max_length: int = 128, id_col: str = "doc_id") -> DataFrame:
    """``[CLS] text [SEP]`` with type ids 0, unpadded."""
    words = E.encode_texts(df, table, special["[UNK]"], {"text": "_w"}, id_col)
    ids = E.encode_single(flat("_w"), special, max_length)
    return words.select(id_col, ids.alias("input_ids"))


def pair_examples(
    df: DataFrame, table: DataFrame, special: Mapping[str, int], fields: tuple[str, str], max_length: int = 128, id_col: str = "doc_id"
) -> DataFrame:
    words = E.encode_texts(df, table, special["[UNK]"], {fields[0]: "_a", fields[1]: "_b"}, id_col)
    return words.select(id_col, E.encode_pair(flat("_a"), flat("_b"), special, max_length).alias("_e")).select(id_col, "_e.*")


def last_word_examples(
    df: DataFrame, table: DataFrame, special: Mapping[str, int], max_length: int = 128, id_col: str = "id"
) -> DataFrame:
    """Encode both sentences and mask the label word right before the first separator."""
    fields = {"sentence1": "_a", "sentence2": "_b", "label": "_t"}
    words = E.encode_texts(df, table, special["[UNK]"], fields, id_col)
    pair = E.encode_pair(flat("_a"), flat("_b"), special, max_length)["input_ids"]
    masked = words.select(id_col, pair.alias("_ids"), F.size(flat("_t")).alias("_n")).select(
        id_col, M.mask_before_sep(F.col("_ids"), F.col("_n"), special).alias("_m")
    )
    return masked.select(id_col, "_m.*")


def dual_examples(
    df: DataFrame, teacher: DataFrame, student: DataFrame, special: Mapping[str, int], inverse: bool = False,
    max_length: int = 128, id_col: str = "doc_id",
) -> DataFrame:
    """Padded teacher and student encodings of original and phonetic text, swapped by ``inverse``."""
    columns = ("text", "original_text") if inverse else ("original_text", "text")
    sides = None
    for name, column, table in zip(("teacher", "student"), columns, (teacher, student)):
        words = E.encode_texts(df, table, special["[UNK]"], {column: "_w"}, id_col)
        ids = words.select(id_col, E.encode_single(flat("_w"), special, max_length).alias("_ids"))
        side = ids.select(
            id_col,
            E.pad_to(F.col("_ids"), max_length, special["[PAD]"]).alias(f"{name}_input_ids"),
            E.attention(F.col("_ids"), max_length).alias(f"{name}_attention_mask"),
        )
        sides = side if sides is None else sides.join(side, id_col)
    return sides


def collate_dual(
    dual: DataFrame, special: Mapping[str, int], vocab_size: int, seed: int | str = 42, id_col: str = "doc_id"
) -> DataFrame:
    """Mask the student side only; the teacher side stays whole."""
    masked = M.mlm_mask(F.col("student_input_ids"), F.col(id_col), special, vocab_size, seed)
    return dual.withColumn("_m", masked).select(
        id_col, "teacher_input_ids", "teacher_attention_mask",
        F.col("_m.input_ids").alias("student_input_ids"), "student_attention_mask", F.col("_m.labels").alias("labels"),
    )


def build_bilingual_mlm(
    df: DataFrame,
    table: DataFrame,
    special: Mapping[str, int],
    vocab_size: int,
    max_length: int = 128,
    seed: int | str = 42,
    id_col: str = "doc_id",
) -> DataFrame:
    """Aligned masked examples from ``original_text`` and ``text``; rows without words are skipped."""
    words = E.encode_texts(df, table, special["[UNK]"], {"original_text": "_a", "text": "_b"}, id_col)
    usable = words.filter((F.size("_a") > 0) & (F.size("_b") > 0))
    budget = max_length // 2 - 2
    row = F.col(id_col)
    kinds = usable.select(
        id_col, "_a", "_b", M.aligned_word_kinds(F.col("_a"), F.col("_b"), row, budget, seed).alias("_k")
    )
    example = M.bilingual_example(F.col("_a"), F.col("_b"), F.col("_k"), row, special, vocab_size, max_length, seed)
    return kinds.select(id_col, example.alias("_e")).select(id_col, "_e.*")
