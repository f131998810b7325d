"""Split-partitioned corpora and task tables on shared storage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)


def dataset_dir(root: str, name: str, phonetic: bool = False, cleaned: bool = False) -> str:
    """``root/[cleaned_][phonetic_]name``."""
    return f"{root}/{'cleaned_' if cleaned else ''}{'phonetic_' if phonetic else ''}{name}"


def task_dir(root: str, task: str, phonetic: bool = False) -> str:
    return f"{root}/glue_data/{'phonetic' if phonetic else 'original'}/{task}"


def spread_small_input(df: DataFrame) -> DataFrame:
    """Deal a small input out to all cores before CPU-heavy text work.

    A table that comes in fewer splits than the session has cores (for instance one file with one
    row group) would run in one task. Larger inputs have enough splits and stay as they are, so
    no shuffle is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load_corpus(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Open a corpus written by :func:`write_corpus`; a missing folder is a ValueError."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise ValueError(f"dataset {path} not found") from error
        raise


def write_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One folder per split, so that readers prune splits."""
    df.write.mode(mode).partitionBy("split").parquet(path)
    return path


def stitch_mnli(task: DataFrame, matched: DataFrame, mismatched: DataFrame) -> DataFrame:
    """Training rows of the task; validation and test rows of both variants under their own names."""
    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        held_out = df.filter(F.col("split").isin("validation", "test"))
        return held_out.withColumn("split", F.concat_ws("_", "split", F.lit(suffix)))

    train = task.filter(~F.col("split").isin("validation", "test"))
    return train.unionByName(renamed(matched, "matched")).unionByName(renamed(mismatched, "mismatched"))


def load_task(spark: SparkSession, root: str, task: str, phonetic: bool = False) -> DataFrame:
    """One task table; mnli is put together from its matched and mismatched variants."""
    table = load_corpus(spark, task_dir(root, task, phonetic))
    if task != "mnli":
        return table
    variants = [load_corpus(spark, task_dir(root, f"mnli_{v}", phonetic)) for v in ("matched", "mismatched")]
    return stitch_mnli(table, *variants)


def write_task(df: DataFrame, root: str, task: str, phonetic: bool = False) -> str:
    return write_corpus(df, task_dir(root, task, phonetic))


def task_table(df: DataFrame, fields: Mapping[str, str], label: str, idx: str) -> DataFrame:
    """Shape any table into ``idx, <task fields>, label[, split]``; integer ids become bigint, joint keys stay strings."""
    key = F.col(idx)
    columns = [(key if df.schema[idx].dataType.typeName() == "string" else key.cast("bigint")).alias("idx")]
    columns += [F.col(source).alias(name) for name, source in fields.items()]
    columns.append(F.col(label).alias("label"))
    if "split" in df.columns:
        columns.append(F.col("split"))
    return df.select(*columns)
