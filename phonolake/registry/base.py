"""Named queries over the given tables, each next to its SQL oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.session import ensure_checkpoint_dir
from phonolake.sources.corpora import spread_small_input

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is checked by the test suite only."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


TEXT_TABLES = ("documents", "conversations", "pages")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; small text tables are dealt out to all cores."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread_small_input(rows) if name in TEXT_TABLES else rows


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, for queries that exercise sinks."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def big(column) -> Column:
    """Integers leave every query as bigint."""
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def joint_key(*ids) -> Column:
    """One key out of several ids, different for different ids."""
    return F.concat_ws(":", *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids])


def ints_text(column) -> Column:
    """Integer array as a comma-separated string."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array_join(c.cast("array<string>"), ",")


def words_text(column, glue: str = "|") -> Column:
    return F.array_join(F.col(column) if isinstance(column, str) else column, glue)


def r6(column) -> Column:
    return F.round((F.col(column) if isinstance(column, str) else column).cast("double"), 6)
