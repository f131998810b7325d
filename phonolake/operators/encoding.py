"""Token ids from words: greedy pieces, merge replay, fixed templates, padding, decoding."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolake.functions import text as X
from phonolake.operators.cleaning import bounded, lookup
from phonolake.operators.held import MOST_BYTES, Held, hold, look_up
from phonolake.session import ensure_checkpoint_dir

IGNORED = -100
INTS = "array<int>"
# Fixed value: words longer than this become a single unknown token.
LONGEST_WORD = 100


def _no_ids() -> Column:
    return F.array().cast(INTS)


def encode_words(words: DataFrame, vocab: DataFrame, unknown: int, prefix: str = "##") -> DataFrame:
    """``(word, ids)`` by greedy longest match; a word with an unmatched rest is one unknown token.

    Every substring of each distinct word up to the longest token length meets the vocabulary in
    one join, the longest match per start survives, and a fold walks from start to start. ``vocab``
    should be a stored table, since its size is checked first.
    """
    ensure_checkpoint_dir(words.sparkSession)
    distinct = words.select("word").filter(F.col("word") != "").distinct().checkpoint()  # read twice
    n = F.length("word")
    longest = vocab.agg(F.max(F.length("token")).alias("m")).scalar()
    usable = distinct.filter(n <= LONGEST_WORD).withColumn("_longest", longest)
    starts = F.sequence(F.lit(1), n)
    spans = usable.select("word", "_longest", F.explode(starts).alias("start")).select(
        "word",
        "start",
        F.explode(F.sequence(F.lit(1), F.least(F.col("_longest"), n - F.col("start") + 1))).alias("len"),
    )
    piece = F.substr("word", F.col("start"), F.col("len"))
    tokens = spans.withColumn("token", F.when(F.col("start") == 1, piece).otherwise(F.concat(F.lit(prefix), piece)))
    # Length and id in one number: the longest match is a plain maximum in a hash aggregate.
    packed = (F.shiftleft(F.col("len").cast("bigint"), 32) + F.col("id")).alias("packed")
    longest_match = (
        tokens.join(bounded(vocab.select("token", "id")), "token")
        .select("word", "start", packed)
        .groupBy("word", "start")
        .agg(F.max("packed").alias("packed"))
    )
    step = F.struct(
        "start",
        F.shiftright("packed", 32).cast("int").alias("len"),
        (F.col("packed") % (1 << 32)).cast("int").alias("id"),
    )
    matches = longest_match.groupBy("word").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    begin = F.struct(F.lit(1).alias("at"), _no_ids().alias("ids"))

    def walk(state: Column, step: Column) -> Column:
        here = state["at"] == step["start"]
        return F.struct(
            F.when(here, state["at"] + step["len"]).otherwise(state["at"]).alias("at"),
            F.when(here, F.concat(state["ids"], F.array(step["id"]))).otherwise(state["ids"]).alias("ids"),
        )

    walked = matches.select("word", F.aggregate("steps", begin, walk).alias("end"))
    complete = walked.filter(F.col("end.at") == n + 1).select("word", F.col("end.ids").alias("ids"))
    return distinct.join(complete, "word", "left").select(
        "word", F.coalesce("ids", F.array(F.lit(unknown))).alias("ids")
    )


def word_ids(vocab: DataFrame) -> DataFrame:
    """Word-level encoding as a ``(word, ids)`` table: one token per word."""
    return vocab.select(F.col("token").alias("word"), F.array("id").alias("ids"))


def replay_merges(words: DataFrame, vocab: DataFrame, merges: DataFrame, unknown: int) -> DataFrame:
    """``(word, ids)`` by applying learned merges in rank order to each distinct word.

    Vocabulary and merge list are bounded by the vocabulary size, so each task receives them
    whole; the words stay distributed.
    """
    spark = words.sparkSession
    ranks = {(r["left"], r["right"]): r["rank"] for r in merges.collect()}
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    shared = spark.sparkContext.broadcast((ranks, ids))

    def pieces(word: str, ranks: dict) -> list[str]:
        symbols = list(word)
        while len(symbols) > 1:
            rank, at = min((ranks.get(pair, len(ranks)), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == len(ranks):
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, ids = shared.value
        for batch in batches:
            encoded = [[ids.get(p, unknown) for p in pieces(w, ranks)] for w in batch["word"]]
            yield pd.DataFrame({"word": batch["word"], "ids": encoded})

    distinct = words.select("word").filter(F.col("word") != "").distinct()
    return distinct.mapInPandas(run, "word string, ids array<int>")


def encode_texts(
    df: DataFrame,
    table: DataFrame,
    unknown: int,
    fields: Mapping[str, str],
    id_col: str = "doc_id",
    splitter=X.split_words_single_punct,
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """``(id, <out> array<array<int>>)``: token ids per word for each text field.

    ``table`` is ``(word, ids)``. Tasks hold it and look words up inside the row, so no token is shuffled; one that is
    too large is joined (``encode_joined``). Rows that share an id give one row, their words in the order of their
    positions; only such rows are joined again. Runs jobs: the table and the ids that repeat are written.
    """
    ensure_checkpoint_dir(df.sparkSession)
    held = hold(table.select("word", "ids"), ["ids"], most_bytes=most_bytes)
    if held is None:
        return encode_joined(df, table, unknown, fields, id_col, splitter)
    again = df.groupBy(F.col(id_col).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_again").checkpoint()
    if again.isEmpty():
        return encode_held(df, held, unknown, fields, id_col, splitter)
    shared, same = bounded(again), F.col(id_col).eqNullSafe(F.col("_again"))
    alone = encode_held(df.join(shared, same, "left_anti"), held, unknown, fields, id_col, splitter)
    return alone.unionByName(encode_joined(df.join(shared, same, "left_semi"), table, unknown, fields, id_col, splitter))


def encode_held(df: DataFrame, held: Held, unknown: int, fields: Mapping[str, str], id_col: str = "doc_id", splitter=X.split_words_single_punct) -> DataFrame:
    """As ``encode_texts`` by a held table, one row for each row."""
    rows = df.select(id_col, *[F.col(name).alias(f"_text{i}") for i, name in enumerate(fields)])
    for i, out in enumerate(fields.values()):
        words = splitter(F.coalesce(F.col(f"_text{i}"), F.lit("")))
        rows = look_up(rows, words, held, "ids", f"_ids{i}", drop=[f"_text{i}"])
    own = [F.transform(f"_ids{i}", lambda ids: F.coalesce(ids, F.array(F.lit(unknown)))).alias(out) for i, out in enumerate(fields.values())]
    return rows.select(id_col, *own)


def encode_joined(
    df: DataFrame,
    table: DataFrame,
    unknown: int,
    fields: Mapping[str, str],
    id_col: str = "doc_id",
    splitter=X.split_words_single_punct,
) -> DataFrame:
    """As ``encode_texts`` for a table of any size.

    Rows are shuffled once by id before they are exploded, and a table small enough for Spark to
    broadcast adds no other shuffle.
    """
    names = list(fields)
    texts = F.array(*[F.coalesce(F.col(name), F.lit("")) for name in names])
    base = df.select(id_col, texts.alias("_texts")).repartition(id_col)
    words = base.select(id_col, F.posexplode("_texts").alias("_field", "_text")).select(
        id_col, "_field", F.posexplode_outer(splitter(F.col("_text"))).alias("_pos", "word")
    )
    found = lookup(words, table.select("word", "ids"), ["word"])
    own = F.when(F.col("word").isNotNull(), F.coalesce("ids", F.array(F.lit(unknown))))
    per_field = found.groupBy(id_col, "_field").agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("_pos", own.alias("ids"))))),
            lambda s: s["ids"],
        ).alias("_ids")
    )
    return per_field.groupBy(id_col).agg(
        *[F.max(F.when(F.col("_field") == i, F.col("_ids"))).alias(fields[name]) for i, name in enumerate(names)]
    )


def encode_single(ids: Column, special: Mapping[str, int], max_length: int) -> Column:
    """``[CLS] A [SEP]`` cut to ``max_length``."""
    return F.concat(
        F.array(F.lit(special["[CLS]"])), F.slice(ids, 1, max_length - 2), F.array(F.lit(special["[SEP]"]))
    )


def pair_lengths(a: Column, b: Column, max_length: int) -> tuple[Column, Column]:
    """Kept lengths of both sides under longest-first truncation, in closed form."""
    budget = max_length - 3
    half = budget // 2
    n, m = F.size(a), F.size(b)
    short = F.least(n, m)
    fits = n + m <= budget
    first_is_short = n <= m
    tight = short > budget - short
    keep_short = F.when(tight, F.lit(half)).otherwise(short)
    keep_long = F.when(tight, F.lit(budget - half)).otherwise(budget - short)
    keep_a = F.when(fits, n).when(first_is_short, keep_short).otherwise(keep_long)
    keep_b = F.when(fits, m).when(first_is_short, keep_long).otherwise(keep_short)
    return keep_a, keep_b


def encode_pair(a: Column, b: Column, special: Mapping[str, int], max_length: int) -> Column:
    """Struct of ``input_ids`` and ``token_type_ids`` for ``[CLS] A [SEP] B [SEP]``."""
    keep_a, keep_b = pair_lengths(a, b, max_length)
    sep = F.array(F.lit(special["[SEP]"]))
    one = F.slice(a, F.lit(1), keep_a)
    two = F.slice(b, F.lit(1), keep_b)
    ids = F.concat(F.array(F.lit(special["[CLS]"])), one, sep, two, sep)
    types = F.concat(F.array_repeat(F.lit(0), keep_a + 2), F.array_repeat(F.lit(1), keep_b + 1))
    return F.struct(ids.alias("input_ids"), types.alias("token_type_ids"))


def pad_to(values: Column, size: Column | int, fill: int) -> Column:
    """Fill up to ``size``; longer arrays stay as they are."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(size - F.size(values), F.lit(0))))


def attention(ids: Column, size: Column | int) -> Column:
    return pad_to(F.transform(ids, lambda _: F.lit(1)), size, 0)


def pad_fixed(df: DataFrame, special: Mapping[str, int], max_length: int = 128, ids: str = "input_ids") -> DataFrame:
    """Pad ids, add attention; a ``labels`` column is padded with -100 and types with 0."""
    out = df.withColumn("attention_mask", attention(F.col(ids), max_length))
    if "labels" in df.columns:
        out = out.withColumn("labels", pad_to(F.col("labels"), max_length, IGNORED))
    if "token_type_ids" in df.columns:
        out = out.withColumn("token_type_ids", pad_to(F.col("token_type_ids"), max_length, 0))
    return out.withColumn(ids, pad_to(F.col(ids), max_length, special["[PAD]"]))


def pad_dynamic(df: DataFrame, special: Mapping[str, int], batch: str = "batch", ids: str = "input_ids") -> DataFrame:
    """Pad to the longest row of the batch; batches are small by definition."""
    longest = F.max(F.size(ids)).over(W.partitionBy(batch))
    return (
        df.withColumn("_longest", longest)
        .withColumn("attention_mask", attention(F.col(ids), F.col("_longest")))
        .withColumn(ids, pad_to(F.col(ids), F.col("_longest"), special["[PAD]"]))
        .drop("_longest")
    )


def decode_ids(
    df: DataFrame, vocab: DataFrame, skip: Sequence[int] = (), ids: str = "input_ids", id_col: str = "doc_id"
) -> DataFrame:
    """``(id, text)``: tokens joined by spaces, special ids in ``skip`` left out.

    Only ids are shuffled, whole arrays at a time; tasks hold the vocabulary, or join one that is too large.
    """
    base = df.select(id_col, F.coalesce(ids, F.array().cast(df.schema[ids].dataType)).alias("_ids")).repartition(id_col)
    held = hold(vocab.select(F.col("id").cast("string").alias("word"), "token"), ["token"])
    if held is None:
        spread = base.select(id_col, F.posexplode_outer("_ids").alias("_pos", "id"))
        if skip:
            spread = spread.withColumn("id", F.when(~F.col("id").isin(list(skip)), F.col("id")))
        named = lookup(spread, vocab.select("id", "token"), ["id"])
        ordered = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("_pos", "token"))))
        return named.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda s: s["token"]), " ").alias("text"))
    placed = F.transform("_ids", lambda x, i: F.struct(i.alias("_pos"), x.alias("id")))
    rows = base.groupBy(id_col).agg(F.flatten(F.collect_list(placed)).alias("_placed"))
    rows = rows.withColumn("_placed", F.filter("_placed", lambda s: ~s["id"].isin(list(skip)) if skip else F.lit(True)))
    rows = look_up(rows, F.transform("_placed", lambda s: s["id"].cast("string")), held, "token", "_tokens")
    both = F.zip_with("_placed", "_tokens", lambda s, token: F.struct(s["_pos"].alias("_pos"), token.alias("token")))
    ordered = F.array_sort(F.filter(both, lambda s: s["token"].isNotNull()))
    return rows.select(id_col, F.array_join(F.transform(ordered, lambda s: s["token"]), " ").alias("text"))


def word_token_offsets(word_ids_column: Column) -> Column:
    """First token position of each word: an exclusive running sum of the token counts."""
    begin = F.struct(F.lit(0).alias("at"), _no_ids().alias("out"))

    def step(state: Column, ids: Column) -> Column:
        return F.struct(
            (state["at"] + F.size(ids)).alias("at"),
            F.concat(state["out"], F.array(state["at"])).alias("out"),
        )

    return F.aggregate(word_ids_column, begin, step, lambda state: state["out"])


def encode_offsets(df: DataFrame, table: DataFrame, unknown: int, id_col: str = "doc_id") -> DataFrame:
    """One row per token: word number, character span of its word, id, and place in the text.

    ``table`` is ``(word, ids)``, held by the tasks where it fits; spans are zero-based and exclusive at the end.
    """
    base = df.select(id_col, X.word_spans(F.col("text")).alias("_spans"))
    held = hold(table.select("word", "ids"), ["ids"])
    if held is None:
        words = base.select(id_col, F.posexplode("_spans").alias("word_no", "_s")).select(id_col, "word_no", "_s.word", "_s.start")
        found = lookup(words, table.select("word", "ids"), ["word"])
    else:
        rows = look_up(base, F.transform("_spans", lambda s: s["word"]), held, "ids", "_ids")
        both = F.zip_with("_spans", "_ids", lambda s, ids: F.struct(s["word"].alias("word"), s["start"].alias("start"), ids.alias("ids")))
        found = rows.select(id_col, F.posexplode(both).alias("word_no", "_s")).select(id_col, "word_no", "_s.*")
    ids = F.coalesce("ids", F.array(F.lit(unknown)))
    return found.select(
        id_col,
        "word_no",
        "start",
        (F.col("start") + F.length("word")).alias("end"),
        F.posexplode(ids).alias("piece_no", "id"),
    )


def batch_score(df: DataFrame, predict, columns: Sequence[str], schema: str, batch_size: int = 256) -> DataFrame:
    """Apply ``predict(pandas frame) -> pandas frame`` to bounded batches; rows keep their id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), batch_size):
                yield predict(frame.iloc[start : start + batch_size].reset_index(drop=True))

    return df.select(*columns).mapInPandas(run, schema)
