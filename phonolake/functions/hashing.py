"""Reproducible draws: the value depends on the row's identity, never on its partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4294967296  # 2**32


def _text(seed: int | str, ids: tuple) -> Column:
    columns = [i if isinstance(i, Column) else F.col(i) for i in ids]
    return F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns])


def hash_bits(seed: int | str, *ids: Column | str) -> Column:
    """32 hash bits as a bigint."""
    return F.conv(F.substring(F.md5(_text(seed, ids)), 1, 8), 16, 10).cast("bigint")


def hash_unit(seed: int | str, *ids: Column | str) -> Column:
    """Uniform number in [0, 1) derived from the seed and the row identity."""
    return hash_bits(seed, *ids) / F.lit(float(SPAN))


def hash_below(n: Column | int, seed: int | str, *ids: Column | str) -> Column:
    """Uniform integer in [0, n)."""
    bound = n if isinstance(n, Column) else F.lit(n)
    return F.floor(hash_unit(seed, *ids) * bound).cast("bigint")
