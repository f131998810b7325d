"""CSV, text and result files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from phonolake.functions.scores import clamp_regression, label_to_name
from phonolake.operators.positions import ordered_index
from phonolake.sources.catalog import LABEL_NAMES


def read_csv_table(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = False) -> DataFrame:
    """Header CSV with an explicit schema; ``multiline`` for cells that contain newlines."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """One stripped word per line."""
    return words_from_lines(spark.read.text(path))


def words_from_lines(lines: DataFrame) -> DataFrame:
    return lines.select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("word"))


def read_ragged_lists(spark: SparkSession, path: str) -> DataFrame:
    """Comma lines of any width as one array per row."""
    return lists_from_lines(spark.read.text(path))


def lists_from_lines(lines: DataFrame) -> DataFrame:
    return lines.select(F.split(F.trim("value"), ",").alias("words"))


def write_csv_splits(df: DataFrame, path: str) -> str:
    """Header CSV, one folder per split, no index column; white space and carriage returns at the ends of cells stay."""
    whole = df.write.mode("overwrite").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    whole.option("header", True).option("escape", '"').partitionBy("split").csv(path)
    return path


def write_text_shards(df: DataFrame, path: str, order: Sequence[str], column: str = "text", lines_per_file: int = 10_000) -> str:
    """Lines in files of exactly ``lines_per_file`` rows, the last one excepted, numbered over all splits.

    Rows follow ``order``, which identifies a row. File ``k`` is the only one in the folder ``shard=k`` and holds rows
    ``k * lines_per_file`` and on, in order, whatever the partitions were. An array in ``column`` gives a line for each
    of its values, so that texts are sorted and not their words. Line feeds inside a value would break it in two, so
    they become spaces; null values are empty lines.
    """
    plain = lambda c: F.translate(F.coalesce(c, F.lit("")), "\n", " ")
    several = df.schema[column].dataType.typeName() == "array"
    lines = F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), plain) if several else F.array(plain(F.col(column)))
    placed = ordered_index(df.select(*order, lines.alias("_lines")).filter(F.size("_lines") > 0), order, out="_at", value=F.size("_lines").cast("bigint"))
    shard = lambda at: F.floor(at / lines_per_file).cast("bigint")
    shards = F.sequence(shard(F.col("_at")), shard(F.col("_at") + F.size("_lines") - 1))
    cut = placed.select("_at", "_lines", F.explode(shards).alias("shard"))
    first = F.greatest(F.col("shard") * lines_per_file - F.col("_at"), F.lit(0)).cast("int")
    size = (F.least((F.col("shard") + 1) * lines_per_file - F.col("_at"), F.size("_lines").cast("bigint")) - first).cast("int")
    # the lines of a piece are one value, written as they stand
    pieces = cut.select("shard", "_at", F.array_join(F.slice("_lines", first + 1, size), "\n").alias("value"))
    rows = pieces.repartition("shard").sortWithinPartitions("shard", "_at").select("value", "shard")
    rows.write.mode("overwrite").partitionBy("shard").text(path)
    return path


def shard_lines(spark: SparkSession, path: str) -> DataFrame:
    """``shard``, ``file`` and ``value`` of the written lines, read back by file name."""
    lines = spark.read.option("lineSep", "\n").schema("value string, shard bigint").text(path)
    return lines.select("shard", F.input_file_name().alias("file"), "value")


def append_lines(df: DataFrame, path: str, column: str = "text", blank_between: bool = False, run_id: str | None = None) -> str:
    """Append one entry per line; poems get a blank line after each entry.

    Every run has a folder of its own below ``path`` and is there as a whole once its job has ended: a job that is
    run again under the same ``run_id`` replaces its lines instead of doubling them. Without ``run_id`` each call is a
    run. Read with :func:`read_appended`.
    """
    value = F.concat(F.col(column), F.lit("\n")) if blank_between else F.col(column)
    return _append_run(df.select(value.alias("value")), path, run_id)


def _append_run(lines: DataFrame, path: str, run_id: str | None) -> str:
    lines.write.mode("overwrite").text(f"{path}/run={run_id or uuid.uuid4().hex}")
    return path


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """``run`` and ``value`` of all runs whose job has ended."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    system = root.getFileSystem(context._jsc.hadoopConfiguration())
    folders = [f.getPath() for f in system.listStatus(root) if f.isDirectory()] if system.exists(root) else []
    done = [str(f) for f in folders if system.exists(hadoop.Path(f, "_SUCCESS"))]
    if not done:
        return spark.createDataFrame([], "run string, value string")
    lines = spark.read.option("lineSep", "\n").option("basePath", path).schema("value string, run string").text(done)
    return lines.select("run", "value")


def write_metric_log(summary: DataFrame, path: str, run_id: str | None = None) -> str:
    """Append ``model, task, metric, {mean, std}`` as tab-separated lines, in runs as ``append_lines`` does."""
    return _append_run(metric_lines(summary).select(F.concat_ws("\t", "model", "task", "metric", "values").alias("value")), path, run_id)


def metric_lines(summary: DataFrame) -> DataFrame:
    values = F.format_string("{'mean': %s, 'std': %s}", F.col("mean").cast("string"), F.col("std").cast("string"))
    return summary.select("model", "task", "metric", values.alias("values"))


def submission_table(predictions: DataFrame, task: str, missing: str = "skip") -> DataFrame:
    """``index, prediction`` from ``idx, pred``; gaps are skipped or left empty.

    Class names where the task has them, three clamped decimals for the regression task.
    """
    if missing not in ("skip", "empty"):
        raise ValueError("missing must be 'skip' or 'empty'")
    if task == "stsb":
        printed = clamp_regression(F.col("pred").cast("double"))
    elif task in LABEL_NAMES:
        printed = label_to_name(F.col("pred"), LABEL_NAMES[task])
    else:
        printed = F.col("pred").cast("string")
    named = predictions.select(F.col("idx").alias("index"), printed.alias("prediction"))
    if missing == "skip":
        return named.filter(F.col("prediction").isNotNull())
    return index_scatter(named).select("index", F.coalesce("prediction", F.lit("")).alias("prediction"))


def index_scatter(named: DataFrame, index: str = "index") -> DataFrame:
    """All indexes from 0 to the largest one; rows without a match are null.

    Blocks of 65 536 indexes are spread first and filled afterwards, all inside the plan.
    """
    width = 16
    top = named.agg(F.max(index)).scalar()
    last_block = F.shiftright(F.max(index), width)
    blocks = (
        named.agg(F.sequence(F.lit(0).cast("bigint"), last_block.cast("bigint")).alias("_blocks"))
        .select(F.explode("_blocks").alias("_block"))
        .repartition("_block")
    )
    last = F.least(F.shiftleft(F.col("_block") + 1, width) - 1, top.cast("bigint"))
    whole = blocks.select(F.explode(F.sequence(F.shiftleft(F.col("_block"), width), last)).alias(index))
    return whole.join(named, index, "left")


def write_submission(table: DataFrame, path: str) -> str:
    """Header and tab-separated rows, sorted by index across the part files."""
    table.orderBy("index").write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    return path
