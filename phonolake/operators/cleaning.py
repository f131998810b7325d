"""Row filters, duplicate removal and chunking of corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.functions import text as X
from phonolake.session import ensure_checkpoint_dir


def map_text(df: DataFrame, fn, column: str = "text", **options) -> DataFrame:
    """Apply a text expression to one column."""
    return df.withColumn(column, fn(F.col(column), **options))


def filter_nonempty(df: DataFrame, column: str = "text") -> DataFrame:
    return df.filter(F.length(column) > 0)


def filter_equals(df: DataFrame, columns: Sequence[str], values: Sequence) -> DataFrame:
    """Keep rows where every named column holds one of the values."""
    out = df
    for name in columns:
        out = out.filter(F.col(name).isin(list(values)))
    return out


def filter_line_length(df: DataFrame, column: str = "text", newline: bool = True) -> DataFrame:
    """2 < length < 100, counting the line's newline by default."""
    length = F.length(column) + (1 if newline else 0)
    return df.filter((length > 2) & (length < 100))


def filter_bracket_lines(df: DataFrame, column: str = "text") -> DataFrame:
    """Drop lines that hold both an opening and a closing square bracket."""
    cell = F.col(column)
    return df.filter(~(cell.contains("[") & cell.contains("]")))


def filter_plain_words(df: DataFrame, column: str = "word") -> DataFrame:
    return df.filter(~F.col(column).rlike(r"[()\- '.]"))


def drop_blank_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for name in columns:
        df = df.filter(F.col(name).isNull() | (F.col(name) != ""))
    return df.dropna(subset=list(columns))


def dedup_exact(
    df: DataFrame, column: str = "text", order: str | Sequence[str] = "doc_id", scope_cols: Sequence[str] = ()
) -> DataFrame:
    """Keep the first row per text hash by one or several order columns, over the whole table by default.

    ``scope_cols`` limits the comparison to rows of the same scope, for instance a batch number.
    Copies collapse in the map-side aggregate, so a text that fills a third of the table sends
    one row per map task.
    """
    rows = F.struct(*[F.col(c) for c in df.columns])
    kept = df.groupBy(F.md5(F.col(column)).alias("_hash"), *[F.col(c).alias(f"_s_{c}") for c in scope_cols])
    first = F.col(order) if isinstance(order, str) else F.struct(*order)
    return kept.agg(F.min_by(rows, first).alias("_row")).select("_row.*")


def drop_duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def processed_difference(todo: DataFrame, done: DataFrame, column: str = "word") -> DataFrame:
    """Distinct words not processed yet."""
    return todo.select(column).distinct().join(done.select(column), column, "left_anti")


def chunk_words(
    df: DataFrame, size: int = 100, column: str = "text", splitter=X.split_words, index: str | None = None
) -> DataFrame:
    """One row per chunk of ``size`` words; texts without words give no row."""
    rest = [c for c in df.columns if c != column]
    words = df.select(*rest, splitter(F.col(column)).alias("_words"))
    pieces = F.posexplode(X.chunks(F.col("_words"), size)).alias(index or "_chunk", column)
    out = words.select(*rest, pieces)
    return out if index else out.drop("_chunk")


def concat_corpora(*corpora: DataFrame) -> DataFrame:
    """Union by name after checking that the column types agree."""
    first = corpora[0]
    for other in corpora[1:]:
        assert_same_schema(first, other)
        first = first.unionByName(other)
    return first


def assert_same_schema(left: DataFrame, right: DataFrame) -> None:
    a = {f.name: f.dataType for f in left.schema.fields}
    b = {f.name: f.dataType for f in right.schema.fields}
    if a != b:
        raise ValueError(f"column types differ: {a} and {b}")


def concat_labelled_pairs(
    positives: DataFrame, negatives: DataFrame, columns: Sequence[str] = ("word1", "word2")
) -> DataFrame:
    """Positives with label 1 and negatives with label 0."""
    one = positives.select(*columns, F.lit(1).alias("label"))
    return one.unionByName(negatives.select(*columns, F.lit(0).alias("label")))


def unify_features(df: DataFrame, fields: Sequence[str], label: str = "label") -> DataFrame:
    """Task fields as one array column next to the label."""
    keep = [c for c in df.columns if c not in {*fields, label}]
    return df.select(*keep, F.array(*fields).alias("features"), F.col(label).alias("label"))


def explode_words(df: DataFrame, splitter=X.split_words, column: str = "text") -> DataFrame:
    """One row per word with its position, next to the other columns."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(splitter(F.col(column))).alias("pos", "word"))


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """N:1 lookup. ``table`` has unique keys.

    No hint on purpose: Spark broadcasts the table only when its measured size is under the
    session's broadcast threshold and shuffles otherwise. In the shuffle case a hot key on the
    probe side (a frequent word) is split by adaptive skew handling, since the table side of a
    split partition is a single row per key.
    """
    return df.join(table, list(keys), how)


def merged_arrays(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One row for each key, the arrays of rows that share it merged by the positions of their values.

    Only keys are shuffled, and the rows whose keys repeat. Runs a job: these keys are written.
    """
    ensure_checkpoint_dir(df.sparkSession)
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys]).checkpoint()
    if again.isEmpty():
        return df.select(*keys, column)
    shared, same = bounded(again), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    placed = F.transform(column, lambda v, i: F.struct(i.alias("at"), v.alias("value")))
    twice = df.join(shared, same, "left_semi").groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(placed))).alias("_all"))
    merged = twice.select(*keys, F.transform("_all", lambda s: s["value"]).alias(column))
    return df.join(shared, same, "left_anti").select(*keys, column).unionByName(merged)


def bounded(table: DataFrame, most: int = 200_000) -> DataFrame:
    """Join side for a stored artifact such as a vocabulary.

    Its rows are counted first, at most ``most`` + 1 of them. Up to ``most`` it is broadcast; beyond
    that a sort-merge join is asked for, so the large side is never broadcast by mistake.
    """
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table.hint("merge")
