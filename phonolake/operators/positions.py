"""Exact row positions and running totals without a window over the whole table.

A position is the sum of three kinds of counts: rows in earlier coarse buckets, rows in
earlier finer buckets of the same coarse bucket, and earlier rows of the same finest bucket.
Only the last step sorts rows, and only inside a finest bucket, so a group that holds a third
of the table is still spread over thousands of tasks. The bucket tables hold counts only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolake.functions.hashing import hash_bits
from phonolake.session import ensure_checkpoint_dir

_BEFORE = (W.unboundedPreceding, -1)


def _earlier(value: Column, partition: Sequence[str], order) -> Column:
    window = W.partitionBy(*partition).orderBy(*order).rowsBetween(*_BEFORE)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def running_total(
    df: DataFrame,
    levels: Sequence[str],
    order: Sequence[Column],
    value: Column | None = None,
    groups: Sequence[str] = (),
    out: str = "before",
    total: str | None = None,
) -> DataFrame:
    """Add ``out`` = sum of ``value`` (default: 1 per row) over all earlier rows of the group.

    ``levels`` are bucket columns from coarse to fine that grow with ``order``. ``total`` also
    adds the group's whole sum. The level columns stay in the output for the caller to drop.
    """
    value = F.lit(1) if value is None else value
    groups = list(groups)
    sums = df.groupBy(*groups, *levels).agg(F.sum(value).alias("_sum"))
    tables = [sums]
    for depth in range(len(levels) - 1, 0, -1):
        tables.insert(0, tables[0].groupBy(*groups, *levels[:depth]).agg(F.sum("_sum").alias("_sum")))

    offsets = None
    for depth, table in enumerate(tables):
        above = groups + list(levels[:depth])
        here = [*above, levels[depth]]
        columns = [
            *here,
            _earlier(F.col("_sum"), above, [F.col(levels[depth])]).alias("_own"),
        ]
        if depth == 0 and total:
            columns.append(F.sum("_sum").over(W.partitionBy(*groups)).alias(total))
        step = table.select(*columns)
        if offsets is None:
            offsets = step.withColumnRenamed("_own", "_offset")
        else:
            offsets = (
                step.join(offsets, above)
                .withColumn("_offset", F.col("_offset") + F.col("_own"))
                .drop("_own")
            )
    finest = groups + list(levels)
    return (
        df.join(offsets, finest)
        .withColumn(out, F.col("_offset") + _earlier(value, finest, order))
        .drop("_offset")
    )


def dense_index(df: DataFrame, id_col: str, out: str = "pos") -> DataFrame:
    """Zero-based position by a unique integer id.

    Ids are unique, so a bucket of 2**20 consecutive ids never holds more rows than that, and
    the bucket counts of 2**40 consecutive ids fit one window of the same size.
    """
    levels = ["_id40", "_id20"]
    keyed = df.withColumn("_id40", F.shiftright(F.col(id_col).cast("bigint"), 40)).withColumn(
        "_id20", F.shiftright(F.col(id_col).cast("bigint"), 20)
    )
    return running_total(keyed, levels, [F.col(id_col)], out=out).drop(*levels)


def ordered_index(df: DataFrame, order: Sequence[str], out: str = "pos", value: Column | None = None) -> DataFrame:
    """Zero-based position by any columns that identify a row, or the sum of ``value`` over all earlier rows.

    Rows are dealt by ranges of the order and written to the checkpoint folder, so that a range is a
    bucket; only the counts of the ranges are added up.
    """
    ensure_checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    return running_total(dealt, ["_range"], [F.col(c) for c in order], value=value, out=out).drop("_range")


def shuffled_index(
    df: DataFrame,
    seed: int | str,
    ids: Sequence[str],
    groups: Sequence[str] = (),
    out: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Zero-based position in hash order (a seeded permutation), per group when given.

    ``ids`` identify a row. 4096 buckets per group keep a hot group spread out.
    """
    return hashed_index(with_hash_bits(df, seed, ids), ids, groups, out, total)


def with_hash_bits(df: DataFrame, seed: int | str, ids: Sequence[str]) -> DataFrame:
    """``df`` with the hash that orders ``shuffled_index``; written, it is not computed for each reading of the rows.

    It is never null; said so, the join by bucket needs no filter, which would compute it again.
    """
    return df.withColumn("_bits", F.coalesce(hash_bits(seed, *ids), F.lit(0)))


def hashed_index(
    df: DataFrame, ids: Sequence[str], groups: Sequence[str] = (), out: str = "pos", total: str | None = None
) -> DataFrame:
    """The second half of ``shuffled_index``: positions of the rows of ``with_hash_bits``."""
    keyed = df.withColumn("_bucket", F.shiftright("_bits", 20))
    order = [F.col("_bits"), *[F.col(i) for i in ids]]
    return running_total(keyed, ["_bucket"], order, groups=groups, out=out, total=total).drop(
        "_bits", "_bucket"
    )


def average_ranks(df: DataFrame, score: str, by: Sequence[str] = (), weights: Sequence[str] = ("n",)) -> DataFrame:
    """Average rank of each distinct score; ``df`` has one row per (by, score).

    ``weights`` name count columns whose sum is the number of rows with that score. Buckets grow with
    the score: sign, power of two and ten bits of the mantissa, then the next sixteen bits, so scores
    that crowd in one part in 10^7 still spread. Infinite scores come first and last, NaN after all.
    """
    size = sum((F.col(w) for w in weights[1:]), F.col(weights[0]))
    x = F.col(score).cast("double")
    plain = (x != 0) & (F.abs(x) < float("inf"))
    power = F.when(plain, F.floor(F.log2(F.abs(x)))).otherwise(F.when(x == 0, -1100).otherwise(1100)).cast("bigint")
    # the logarithm may round up to the next whole number
    scaled = F.when(plain, F.greatest(F.abs(x) / F.pow(F.lit(2.0), power) - 1, F.lit(0.0))).otherwise(0.0) * F.lit(1024)
    part = F.floor(scaled).cast("bigint")
    fine = F.floor((scaled - part) * F.lit(65536)).cast("bigint")
    magnitude = (power + 1100) * F.lit(1024) + part
    coarse = F.when(F.isnan(x), F.lit(2**40)).when(x < 0, -magnitude).otherwise(magnitude)
    keyed = df.withColumn("_bucket", coarse).withColumn("_fine", F.when(x < 0, -fine).otherwise(fine))
    ranked = running_total(keyed, ["_bucket", "_fine"], [F.col(score)], value=size, groups=by, out="_before")
    return ranked.withColumn("avg_rank", F.col("_before") + (size + 1) / 2).drop("_before", "_bucket", "_fine")
