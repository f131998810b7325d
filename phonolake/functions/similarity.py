"""Ratcliff-Obershelp similarity on Arrow batches of already-blocked pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Argument order matters: the ratio is not symmetric. Two empty sequences give 1.0."""
    return pd.Series(
        [SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64"
    )


@F.pandas_udf(DoubleType())
def symbol_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The same over arrays of symbols."""
    return pd.Series(
        [SequenceMatcher(None, list(a), list(b)).ratio() for a, b in zip(left, right)],
        dtype="float64",
    )


@F.pandas_udf(StringType())
def decompose(words: pd.Series) -> pd.Series:
    """Canonical decomposition; meant for distinct words, not for running text."""
    return words.str.normalize("NFD")


# Filters on the result must not move below the word count, where they would call it per token.
decompose = decompose.asNondeterministic()
