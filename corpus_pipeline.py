"""Five stages from raw documents to encoded training texts.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the
checkpoint folder and reads it again as the next stage's documents. All stages but the last return the columns of
``documents``.

1. quality: documents that the classifier rejects go.
2. line_dedup: repeated passages of two or more lines go from the texts but for their first occurrence; ``n_chars`` follows.
3. near_dedup: one document of each near-duplicate class stays, that of the smallest id.
4. decontamination: documents that hold a benchmark item go.
5. encoding: ids and decoded texts of what is left.

Null texts count as empty and stay null until they go or are encoded; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm import bpe, dart_minhash, latent, line_dedup, quality
from phonolake.llm.common import scratch_tables, stored, table
from phonolake.llm.paths import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.remove_repeated_passages(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return latent.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: SQL cannot express the classifier, the rolling hashes or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_tables(spark):
            docs = stored(stage(spark, docs, sf_dir), name, keep=True)
    return docs
