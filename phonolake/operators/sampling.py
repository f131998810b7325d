"""Seeded shuffles, splits, samples and class balancing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolake.functions.hashing import hash_below, hash_unit
from phonolake.operators.cleaning import bounded
from phonolake.operators.positions import dense_index, shuffled_index


def seeded_shuffle(df: DataFrame, ids: Sequence[str], seed: int | str = 42) -> DataFrame:
    """Permute the rows by a range-partitioned sort on the seeded hash."""
    return df.orderBy(hash_unit(seed, *ids), *[F.col(i) for i in ids])


def head_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def _ceil_share(n: Column, share: float) -> Column:
    # Rounded first: 10 * 0.1 must not become 2 through binary representation.
    return F.ceil(F.round(n * F.lit(share), 9))


def train_val_test_split(
    df: DataFrame,
    ids: Sequence[str],
    test: float = 0.2,
    validation: float = 0.1,
    seed: int | str = 42,
    exact: bool = True,
    hashed: bool = False,
) -> DataFrame:
    """Two-step split: ``test`` of all rows, then ``validation`` of the rest.

    ``exact=True`` gives the sizes ceil(n*test) and ceil((n - n_test)*validation); otherwise each
    row is decided alone by its hash, without any shuffle. ``hashed=True`` says that ``df`` are written rows of
    ``positions.with_hash_bits`` for this seed and these ids: they are read three times, once when called, and only
    those of the two buckets where a split ends are shuffled.
    """
    if hashed:
        return _split_hashed(df, ids, test, validation)
    if not exact:
        first, second = hash_unit(f"{seed}:test", *ids), hash_unit(f"{seed}:validation", *ids)
        name = F.when(first < test, "test").when(second < validation, "validation")
        return df.withColumn("split", name.otherwise("train"))
    placed = shuffled_index(df, seed, ids, out="_pos", total="_n")
    n_test = _ceil_share(F.col("_n"), test)
    n_val = _ceil_share(F.col("_n") - n_test, validation)
    name = F.when(F.col("_pos") < n_test, "test").when(F.col("_pos") < n_test + n_val, "validation")
    return placed.withColumn("split", name.otherwise("train")).drop("_pos", "_n")


def _split_hashed(df: DataFrame, ids: Sequence[str], test: float, validation: float) -> DataFrame:
    """The exact split of written rows: buckets of the order are counted, at most 4096, and decide all rows but those of two."""
    keyed = df.withColumn("_bucket", F.shiftright("_bits", 20))
    counts = sorted((r["_bucket"], r["count"]) for r in keyed.groupBy("_bucket").count().collect())
    n, n_test = F.lit(sum(c for _, c in counts)), F.col("n_test")
    sizes = df.sparkSession.range(1).select(n.alias("n"), _ceil_share(n, test).alias("n_test"))
    ends = sizes.select("n_test", (n_test + _ceil_share(F.col("n") - n_test, validation)).alias("n_both")).first()
    before, edges, split = 0, {}, F.lit("train")
    for bucket, count in counts:
        for end in ends:
            if before < end < before + count:
                edges[bucket] = before
        before += count
    # a bucket that no end divides lies whole on one side of each
    firsts = dict(zip((b for b, _ in counts), accumulate((c for _, c in counts), initial=0)))
    for name, end in (("validation", ends["n_both"]), ("test", ends["n_test"])):
        inside = [b for b, first in firsts.items() if first < end]
        if inside:
            split = F.when(F.col("_bucket") <= max(inside), name).otherwise(split)
    whole = keyed.filter(~F.col("_bucket").isin(list(edges))).withColumn("split", split)
    order = W.partitionBy("_bucket").orderBy("_bits", *ids)
    offset = F.lit(0)
    for bucket, first in edges.items():
        offset = F.when(F.col("_bucket") == bucket, F.lit(first)).otherwise(offset)
    pos = F.row_number().over(order) - 1 + offset
    name = F.when(F.col("_pos") < ends["n_test"], "test").when(F.col("_pos") < ends["n_both"], "validation").otherwise("train")
    placed = keyed.filter(F.col("_bucket").isin(list(edges))).withColumn("_pos", pos).withColumn("split", name).drop("_pos")
    return whole.unionByName(placed).drop("_bits", "_bucket")


def sample_n(df: DataFrame, n: int, ids: Sequence[str], seed: int | str = 42) -> DataFrame:
    """Exactly min(n, rows) seeded rows, without collecting them in one task."""
    return shuffled_index(df, seed, ids, out="_pos").filter(F.col("_pos") < n).drop("_pos")


def cap_splits(
    df: DataFrame, caps: Mapping[str, int], ids: Sequence[str], seed: int | str = 42, split: str = "split"
) -> DataFrame:
    """At most ``caps[split]`` shuffled rows per split; splits without a cap are dropped."""
    cap = F.lit(None).cast("bigint")
    for name, size in caps.items():
        cap = F.when(F.col(split) == name, F.lit(size)).otherwise(cap)
    wanted = df.filter(F.col(split).isin(list(caps)))
    placed = shuffled_index(wanted, seed, ids, groups=[split], out="_pos")
    return placed.filter(F.col("_pos") < cap).drop("_pos")


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def balanced_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """N / (K * n_c) per class; one window over the class table."""
    everything = W.partitionBy()
    return class_counts(df, label).select(
        label,
        "n",
        (F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))).alias("weight"),
    )


def inverse_frequency_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight 1/n_c on each row, by a lookup in the aggregated class table; null is a class too.

    Counts the classes when it is called, and broadcasts their table only while it is small.
    """
    weights = class_counts(df, label).select(F.col(label).alias("_class"), (F.lit(1.0) / F.col("n")).alias("weight"))
    return df.join(bounded(weights), F.col(label).eqNullSafe(F.col("_class"))).drop("_class")


def oversample_classes(df: DataFrame, label: str = "label", base: int = 0) -> DataFrame:
    """Repeat each class floor(n_base / n_c) times; the base class stays once.

    Classes larger than the base class get zero copies, as integer division says.
    """
    counts = class_counts(df, label)
    base_n = counts.filter(F.col(label) == base).select(F.col("n").alias("base_n")).scalar()
    times = counts.select(
        label,
        F.when(F.col(label) == base, F.lit(1)).otherwise(F.floor(base_n / F.col("n"))).cast("int").alias("times"),
    ).filter(F.col("times") > 0)
    copies = df.join(times, label)
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def weighted_sample_replacement(
    df: DataFrame, id_col: str, label: str = "label", seed: int | str = 42
) -> DataFrame:
    """As many draws as rows, each row with probability proportional to 1/n_class.

    Every class then weighs the same, so a draw picks a class uniformly and a member uniformly.
    """
    members = shuffled_index(df, f"{seed}:order", [id_col], groups=[label], out="_member")
    classes = (
        class_counts(df, label)
        .withColumn("_class", F.row_number().over(W.orderBy(label)) - 1)
        .withColumn("_classes", F.count(F.lit(1)).over(W.partitionBy()))
    )
    k = classes.agg(F.max("_classes")).scalar()
    draws = df.select(F.col(id_col).alias("draw")).withColumn(
        "_class", hash_below(k, f"{seed}:class", F.col("draw"))
    )
    placed = draws.join(classes, "_class").withColumn(
        "_member", hash_below(F.col("n"), f"{seed}:member", F.col("draw"))
    )
    return placed.select("draw", label, "_member").join(members, [label, "_member"]).drop("_member")


def alternate_rows(df: DataFrame, id_col: str, out: str = "pos") -> DataFrame:
    """Rows at even positions in id order."""
    return dense_index(df, id_col, out).filter(F.col(out) % 2 == 0)


def assign_batches(df: DataFrame, id_col: str, size: int, out: str = "batch") -> DataFrame:
    """Number of the consecutive batch of ``size`` rows in id order."""
    return (
        dense_index(df, id_col, "_pos")
        .withColumn(out, F.floor(F.col("_pos") / size).cast("bigint"))
        .drop("_pos")
    )


def first_k_per_class(df: DataFrame, label: str, order: str, k: int) -> DataFrame:
    """The first ``k`` rows of each class by ``order``; Spark keeps ``k`` rows a class before it shuffles."""
    place = F.row_number().over(W.partitionBy(label).orderBy(order))
    return df.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def group_to_set(df: DataFrame, key: str, member: str) -> DataFrame:
    """``listed``, all members of a key with their repeats, and ``members``, the distinct ones; both sorted.

    The result of a key is one row, so keys must have lists that fit a row; null members are left out.
    """
    return df.groupBy(key).agg(F.sort_array(F.collect_list(member)).alias("listed"), F.sort_array(F.collect_set(member)).alias("members"))
