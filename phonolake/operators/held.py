"""Word tables that tasks hold and look up inside a row, so that no token is shuffled.

A table is measured first. Up to ``MOST_BYTES`` it is sent to the tasks as columns sorted by the 64-bit hash of the
word. A larger one is dealt by hash into at most ``MOST_PARTS`` such parts, one written pass over the rows for each.
Beyond that ``hold`` gives None and the caller joins instead. ``look_up_dealt`` takes a table of any size and writes
no tokens.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from phonolake.session import ensure_checkpoint_dir

MOST_BYTES = 128 << 20
MOST_PARTS = 4
#: Words that one step of a lookup takes at once, so that a worker needs little beside its batch and the table.
AT_ONCE = 1 << 18
#: Text of a chunk whose words are looked up in a table of any size.
CHUNK_BYTES = 16 << 20


class Held:
    """Parts of a word table, each a broadcast of sorted hashes, words and value columns."""

    def __init__(self, parts: list, values: Sequence[str], types: Sequence):
        self.parts = parts
        self.values = list(values)
        self.types = list(types)


def written(table: DataFrame, values: Sequence[str], word: str = "word") -> DataFrame:
    """``_hash``, ``_word`` and ``values`` of the words of ``table``, written once."""
    ensure_checkpoint_dir(table.sparkSession)
    return table.select(F.xxhash64(word).alias("_hash"), F.col(word).alias("_word"), *values).where(F.col("_word").isNotNull()).checkpoint()


def hold(table: DataFrame, values: Sequence[str], word: str = "word", most_bytes: int = MOST_BYTES, most_parts: int = MOST_PARTS) -> Held | None:
    """Send ``table`` (unique words; string, double or integer array ``values``) to the tasks, or None if it is too large."""
    return send(written(table, values, word), values, most_bytes, most_parts)


def send(rows: DataFrame, values: Sequence[str], most_bytes: int = MOST_BYTES, most_parts: int = MOST_PARTS) -> Held | None:
    """The second half of ``hold``, for rows of ``written``."""
    spark = rows.sparkSession
    types = [rows.schema[v].dataType for v in values]
    sizes = {"string": F.octet_length, "array": lambda v: 4 * F.size(v) + 4}
    width = [sizes.get(t.typeName(), lambda _: F.lit(8))(v) for v, t in zip(values, types, strict=True)]
    each = sum((F.coalesce(w, F.lit(0)) for w in width), F.octet_length("_word") + 16)
    total = rows.agg(F.coalesce(F.sum(each), F.lit(0)).alias("bytes")).first()["bytes"]
    # parts by hash are about equal, with room for the difference
    n_parts = max(1, math.ceil(1.1 * total / most_bytes)) if total > most_bytes else 1
    if n_parts > most_parts:
        return None
    parts = []
    for part in range(n_parts):
        own = rows if n_parts == 1 else rows.where(F.pmod("_hash", F.lit(n_parts)) == part)
        columns = own.toArrow().combine_chunks().sort_by("_hash")
        hashes = columns.column("_hash").to_numpy()
        if (hashes[1:] == hashes[:-1]).any():
            return None  # two words with one hash: a join tells them apart
        parts.append(spark.sparkContext.broadcast((hashes, *(columns.column(k).combine_chunks() for k in range(1, len(values) + 2)))))
    return Held(parts, values, types)


def _matches(held: tuple, hashes: np.ndarray, words):
    """Row of the held table for each word, and whether there is one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    known = held[0]
    if not len(known) or not len(hashes):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    same = pc.fill_null(pc.equal(held[1].take(pa.array(at)), words), False).to_numpy(zero_copy_only=False)
    return at, (known[at] == hashes) & same


def _flat(column):
    """Values, offsets from 0 and hashes of a list column."""
    offsets = column.offsets.to_numpy()
    return column.flatten(), (offsets - offsets[0]).astype(np.int32)


def _slices(batch, at: int):
    """Slices of a batch with at most ``AT_ONCE`` words in the list column ``at``, or a single row."""
    ends = batch.column(at).offsets.to_numpy()
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + AT_ONCE, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _with_words(df: DataFrame, words: Column) -> DataFrame:
    rows = df.withColumn("_words", F.coalesce(words, F.array().cast("array<string>")))
    return rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))


def look_up(df: DataFrame, words: Column, held: Held, value: str, out: str, drop: Sequence[str] = ()) -> DataFrame:
    """Add ``out``: the held string or array value of each word of the array column, null where there is none. No shuffle.

    Columns in ``drop`` are not needed beyond ``words`` and are left out.
    """
    at = held.values.index(value) + 2
    rows = _with_words(df, words).drop(*drop)
    df = df.drop(*drop)
    own = len(df.columns)
    found_type = ArrayType(held.types[at - 2])
    for k, part in enumerate(held.parts):
        last = k == len(held.parts) - 1
        if k:
            rows = rows.checkpoint()  # a pass of its own, so that a task holds one part at a time
        schema = StructType(list(df.schema.fields))
        if not last:
            schema = schema.add("_words", ArrayType(StringType())).add("_hashes", ArrayType(LongType()))
        schema = schema.add(out, found_type)

        def run(batches, part=part, first=not k, kept=own if last else own + 2, names=schema.names):
            import pyarrow as pa
            import pyarrow.compute as pc

            for whole in batches:
                for batch in _slices(whole, own):
                    flat, offsets = _flat(batch.column(own))
                    hashes, _ = _flat(batch.column(own + 1))
                    row, hit = _matches(part.value, hashes.to_numpy(), flat)
                    found = part.value[at].take(pa.array(row, mask=~hit))
                    if not first:
                        found = pc.coalesce(_flat(batch.column(own + 2))[0], found)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.ListArray.from_arrays(pa.array(offsets), found)], names)

        rows = rows.mapInArrow(run, schema)
    return rows


def look_up_dealt(df: DataFrame, words: Sequence[Column], table: DataFrame, value: str, out: Sequence[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """For each array column of ``words`` add a column of ``out``: the string ``value`` of each word, null where there is none.

    ``table`` has unique ``_word``s and may have any size. Rows are dealt into chunks by their hash; the distinct words
    of a chunk are joined with the table and meet the rows again, so neither tokens nor the whole table travel, and
    beside the shuffled rows only words are written. Counts the bytes of the rows when called.
    """
    spark = df.sparkSession
    hashed = [F.col(f"`{name}`") for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    total = df.agg(*[F.sum(F.octet_length(name)) for name, kind in df.dtypes if kind == "string"]).first()
    chunks = max(spark.sparkContext.defaultParallelism, math.ceil(sum(n or 0 for n in total) / chunk_bytes))
    # both readings take all columns, so that the rows are shuffled once
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*hashed), F.lit(chunks)).cast("int")).repartition(chunks, "_chunk")
    split = dealt.select("*", *[F.coalesce(w, F.array().cast("array<string>")).alias(f"_words_{i}") for i, w in enumerate(words)])
    own, n = len(df.columns), len(words)

    def distinct(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def rows(chunk, parts):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(parts[0]), chunk, np.int32)), parts[0]], ["_chunk", "_word"])

        known: dict[int, list] = {}
        for batch in batches:
            of = batch.column(own).to_numpy()
            for chunk in np.unique(of).tolist():
                some = batch.filter(pa.array(of == chunk))
                parts = known.setdefault(chunk, [])
                parts.extend(pc.unique(some.column(own + 1 + i).flatten()) for i in range(n))
                known[chunk] = parts = [pc.unique(pa.concat_arrays(parts))]
                if len(parts[0]) > AT_ONCE:  # words may then come twice, which the lookup bears
                    yield rows(chunk, known.pop(chunk))
        for chunk, parts in known.items():
            yield rows(chunk, parts)

    def found(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        known, values = (right.column(c).combine_chunks() for c in ("_word", "_value"))
        columns = [left.column(c) for c in range(own)]
        for i in range(n):
            column = left.column(own + 1 + i).combine_chunks()
            flat, offsets = _flat(column)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), values.take(pc.index_in(flat, value_set=known))))
        return pa.Table.from_arrays(columns, names)

    schema = StructType(list(df.schema.fields))
    for name in out:
        schema = schema.add(name, ArrayType(StringType()))
    names = schema.names
    met = split.mapInArrow(distinct, "_chunk int, _word string").join(table.select("_word", F.col(value).alias("_value")), "_word")
    return split.groupBy("_chunk").cogroup(met.select("_chunk", "_word", "_value").groupBy("_chunk")).applyInArrow(found, schema)


def add_up(df: DataFrame, words: Column, held: Held, out: str) -> DataFrame:
    """Add ``out``: for each held double column the sum over the words of the row, or null without a known word."""
    own = len(df.columns)
    rows = _with_words(df, words)
    for k, part in enumerate(held.parts):
        last = k == len(held.parts) - 1
        if k:
            rows = rows.checkpoint()
        schema = StructType(list(df.schema.fields))
        if not last:
            schema = schema.add("_words", ArrayType(StringType())).add("_hashes", ArrayType(LongType()))
        schema = schema.add(out, ArrayType(DoubleType()))

        def run(batches, part=part, first=not k, kept=own if last else own + 2, names=schema.names):
            import pyarrow as pa

            for whole in batches:
                for batch in _slices(whole, own):
                    flat, offsets = _flat(batch.column(own))
                    hashes, _ = _flat(batch.column(own + 1))
                    row, hit = _matches(part.value, hashes.to_numpy(), flat)
                    of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[hit]
                    known = np.bincount(of, minlength=batch.num_rows) > 0
                    weights = [c.to_numpy(zero_copy_only=False)[row[hit]] for c in part.value[2:]]
                    sums = np.stack([np.bincount(of, w, batch.num_rows) for w in weights], 1)
                    before = [None] * batch.num_rows if first else batch.column(own + 2).to_pylist()
                    both = [
                        (now if old is None else [x + y for x, y in zip(old, now, strict=True)]) if some else old
                        for old, now, some in zip(before, sums.tolist(), known.tolist(), strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(both, pa.list_(pa.float64()))], names)

        rows = rows.mapInArrow(run, schema)
    return rows
