"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm import alignment, bpe, dart_minhash, filter_audit, latent, licenses, line_dedup, page_text, quality, secret_scan, spotsigs, suffix_dedup, token_files
from phonolake.llm.common import table
from phonolake.llm.paths import vocabulary

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLES[name] = sql
        return fn

    return wrap


@query("op1_bpe")
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_decode(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query("op7_quality")
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = line_dedup.remove_repeated_passages(docs)
    kept = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "n_lines", "n_lines_removed", "n_chunks_removed", F.length(kept).cast("long").alias("n_chars_kept"), F.sha2(kept, 256).alias("kept_sha256"))


@query("op10_dart_minhash")
def op10_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, folder, "documents"))


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return latent.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def license_sql() -> str:
    """The phrases by word lists, the templates by plain containment of every block with every template."""
    lowered = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in licenses.PHRASES.items())
    sets = licenses.template_sets(licenses.TEMPLATES)
    templates = ", ".join(f"({int(len(w) >= licenses.LONG)}, '{label}', {w}, {licenses.needed(w, 0.8)})" for label, w in sets)
    return f"""
WITH phrases(words, label) AS (VALUES {phrases}), templates(kind, label, words, need) AS (VALUES {templates}),
d AS (SELECT doc_id, {lowered} AS text, regexp_extract_all({lowered}, {word}) AS words FROM documents),
places AS (SELECT doc_id, label, i FROM (SELECT doc_id, words, unnest(range(len(words))) AS i FROM d) AS spots, phrases
  WHERE spots.words[i + 1] = phrases.words[1] AND spots.words[i + 1 : i + len(phrases.words)] = phrases.words),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, 0 AS kind, unnest(string_split(text, chr(10))) AS body FROM d
  UNION ALL SELECT doc_id, 1, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) FROM d),
sets AS (SELECT doc_id, kind, list_distinct(regexp_extract_all(body, {word})) AS own FROM blocks),
shared AS (SELECT doc_id, label, len(list_intersect(own, words)) AS n, need, len(words) AS size FROM sets JOIN templates USING (kind)),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(n / size) AS most FROM shared WHERE n >= need GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query("op6_licenses", license_sql())
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"))


@query("op8_spotsigs")
def op8_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.fingerprint_edits(table(spark, folder, "documents"))


@query("op9_token_files")
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.write_and_read(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op3_page_text")
def op3_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.main_text(table(spark, folder, "pages"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


@query("op11_secrets")
def op11_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_counts(table(spark, folder, "documents"))


@query("op12_filter_audit", filter_audit.audit_sql())
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.cross_align(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
