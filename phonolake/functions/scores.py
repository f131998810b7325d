"""Array and scalar expressions over prediction scores."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax_class(logits: Column) -> Column:
    """Zero-based index of the largest value; the first one wins a tie."""
    return F.array_position(logits, F.array_max(logits)) - 1


def softmax_probs(logits: Column) -> Column:
    """Class probabilities, shifted by the maximum for stability."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp((x - top).cast("double")))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def topk_positions(logits: Column, k: int) -> Column:
    """Zero-based ids of the k largest values, best first, lower id first on ties."""
    keyed = F.transform(logits, lambda x, i: F.struct((-x).alias("key"), i.alias("id")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["id"])


def target_rank(logits: Column, target: Column) -> Column:
    """1-based rank of one id among the scores, ties broken by the lower id."""
    own = F.element_at(logits, (target + 1).cast("int"))
    ahead = F.filter(
        F.transform(logits, lambda x, i: (x > own) | ((x == own) & (i < target))),
        lambda flag: flag,
    )
    return F.size(ahead) + 1


def label_to_name(label: Column, names: Sequence[str]) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), (label + 1).cast("int"))


def clamp_regression(score: Column, low: float = 0.0, high: float = 5.0) -> Column:
    """Clamp into the score range (0 to 5) and print three decimals.

    Rounds the stored binary value as Python's ``%.3f`` does; ``format_string`` would round its
    decimal text instead. The comparison with the half step is exact, because the value times the
    chosen power of two is a whole number.
    """
    x = F.greatest(F.least(score, F.lit(high)), F.lit(low))
    small = x < 0.5
    power = F.when(small, F.lit(2.0**63)).otherwise(F.lit(2.0**60))
    unit = F.when(small, F.lit(Decimal(1 << 63))).otherwise(F.lit(Decimal(1 << 60))).cast("decimal(20,0)")
    below = F.floor(x * 1000).cast("bigint")
    twice = (x * power).cast("bigint").cast("decimal(20,0)") * F.lit(2000).cast("decimal(4,0)")
    half = (2 * below + 1).cast("decimal(10,0)") * unit
    up = F.when((twice > half) | ((twice == half) & (below % 2 == 1)), 1).otherwise(0)
    steps = below + up
    return F.format_string("%d.%03d", F.floor(steps / 1000), steps % 1000)


def model_short_name(path: Column) -> Column:
    """Drop a checkpoint suffix and keep the last part of the path."""
    return F.element_at(F.split(F.regexp_replace(path, r"/checkpoint-.*", ""), "/"), -1)


def linear_score(features: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """Dot product with fixed weights, summed in order."""
    fixed = F.array(*[F.lit(float(w)) for w in weights])
    products = F.zip_with(features, fixed, lambda a, b: a.cast("double") * b)
    return F.aggregate(products, F.lit(float(bias)), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
