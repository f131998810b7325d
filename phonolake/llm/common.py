"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.session import ensure_checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the whole text; a null text is empty. Other columns cannot clash after this."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders written inside the scopes that are open, the innermost last.
SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("SCOPES", default=())


@contextmanager
def scratch_tables(spark: SparkSession):
    """Tables that ``stored`` writes inside are deleted at the end, but for those written with ``keep``.

    What is kept belongs to the scope around, if there is one. Use it where everything that reads the other
    tables has itself been written.
    """
    own: list[str] = []
    outer = SCOPES.get()
    token = SCOPES.set((*outer, own))
    try:
        yield
    finally:
        SCOPES.reset(token)
        context = spark.sparkContext
        for folder in own:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write to the folder of ``spark.checkpoint.dir`` and read back: shared, compressed, and free of lineage."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    scopes = SCOPES.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(folder)
    with shuffles_dropped(spark):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a query that ends inside go at its end, and do not wait for the driver's garbage collector."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def small_batches(batches: Iterator[pa.RecordBatch], text_col: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``most_bytes`` of text, or a single row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text_col))
        if batch.num_rows <= 1 or column.nbytes <= most_bytes:
            if batch.num_rows:
                yield batch
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def per_row(fn: Callable[[pa.RecordBatch], pa.RecordBatch], text_col: str = "text"):
    """A ``mapInArrow`` function from a function of one batch."""

    def run(batches):
        for batch in small_batches(batches, text_col):
            yield fn(batch)

    return run


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key_id``, ``key_hash`` and ``text`` of each row; rows with the same id and the same text share a key.

    A null id counts as the smallest long, a null text as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*key_columns(id_col, text_col), text.alias("text"))


def key_columns(id_col: str, text_col: str) -> list:
    lowest = F.lit(-(2**63))
    return [F.coalesce(F.col(id_col).cast("long"), lowest).alias("key_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key_hash")]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as make it differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
