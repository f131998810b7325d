"""How the filters of a corpus interact: what each removes, in every order of applying them.

Truth-table survival words: bit ``S`` of a document's 32-bit word says whether it survives the subset ``S`` of the
five filters, so one word answers for all 32 subsets at once. Adding up the words position by position gives the
survivors of every subset, per part and label. The addition is carry-save: words are kept as planes of ones, twos,
fours and so on, three words of one plane become one of it and one of the next, and planes are counted at the end.
Every order, step and Shapley value follows from the 32 counts of a part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.llm.common import small_batches

FILTERS = "ABCDE"
N_SUBSETS = 1 << len(FILTERS)
#: Parts that a task adds up side by side before it hands its sums on.
MOST_PARTS = 4096
LOWEST = -(2**63)


def survival_words() -> np.ndarray:
    """Word of each mask of failed filters: bit ``S`` is set where ``S`` holds none of them."""
    subsets = np.arange(N_SUBSETS)
    return np.array([sum(1 << int(s) for s in subsets if not s & failed) for failed in subsets], np.uint32)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the words have bit 0, bit 1, ... bit 31 set, by carry-save addition."""
    counts, weight = np.zeros(32, np.int64), 1
    plane = np.asarray(words, np.uint32)
    while len(plane):
        carried = []
        while len(plane) >= 3:
            third = len(plane) // 3
            a, b, c, rest = plane[:third], plane[third : 2 * third], plane[2 * third : 3 * third], plane[3 * third :]
            half = a ^ b
            carried.append(a & b | half & c)
            plane = np.concatenate([half ^ c, rest])
        for word in plane:
            counts += weight * (int(word) >> np.arange(32) & 1)
        plane, weight = np.concatenate(carried) if carried else plane[:0], weight * 2
    return counts


def text_failures(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """doc_id, part, failed (mask of A to D) and the SHA-256 of each text, without the texts."""
    schema = "doc_id long, part string, failed int, digest binary"

    def judged(batches):
        import hashlib

        import pyarrow.compute as pc

        for batch in small_batches(batches, "text"):
            text = batch.column(1)
            raw = [t.encode() for t in text.to_pylist()]
            words = [t.split() for t in raw]  # bytes are split at exactly \x20 and \x09 to \x0D
            n_words = np.array([len(w) for w in words], np.int64)
            n_distinct = np.array([len(set(w)) for w in words], np.int64)
            n_upper = pc.count_substring_regex(text, "[A-Z]").to_numpy(zero_copy_only=False).astype(np.int64)
            n_points = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            odd = pc.match_substring_regex(text, "[#$%&*|]").to_numpy(zero_copy_only=False)
            tests = [n_words < 100, 100 * n_distinct < 80 * n_words, 100 * n_upper > 10 * n_points, odd]
            failed = sum(t.astype(np.int32) << k for k, t in enumerate(tests))
            digests = pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(failed, pa.int32()), digests], schema_names)

    schema_names = [c.split()[0] for c in schema.split(", ")]
    part = F.coalesce(F.col(part_col), F.lit("")).alias("part")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("doc_id")
    rows = docs.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("text"), part)
    return rows.mapInArrow(judged, schema)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part and ``failed``, the mask of all five filters, for every row; a null id counts as the smallest long.

    Copies are found over the whole table by SHA-256. Only digests that occur with two different ids are joined, so
    rows of a large group of copies meet one row, in a join whose hot key Spark splits.
    """
    judged = text_failures(docs, id_col, text_col, part_col)
    firsts = judged.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    failed = F.col("failed").bitwiseOR(F.when(copy, 1 << FILTERS.index("E")).otherwise(0))
    return judged.join(firsts.select("digest", "first_id"), "digest", "left").select("doc_id", "part", failed.alias("failed"))


def survivors(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, and ``all``, ``good``, ``toxic``: arrays with the survivors of each of the 32 subsets.

    A document is good (toxic) where any label row of its id has quality (toxic) 1; ids that are null have no labels.
    """
    flags = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(flag) for flag, c in (("is_good", "quality"), ("is_toxic", "toxic"))]
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(*flags).where("is_good + is_toxic > 0")
    label = F.coalesce(F.col("is_good") + 2 * F.col("is_toxic"), F.lit(0)).cast("int").alias("label")
    rows = failed.join(marked, "doc_id", "left").select("part", label, "failed")
    schema = "part string, kind int, " + ", ".join(f"n{s} long" for s in range(N_SUBSETS))

    def added(batches):
        words, sums = survival_words(), {}

        def emitted():
            keys = sorted(sums)
            counts = np.array([sums[k] for k in keys], np.int64).reshape(-1, N_SUBSETS)
            columns = [pa.array([p for p, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()), *(pa.array(c) for c in counts.T)]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, ["part", "kind", *(f"n{s}" for s in range(N_SUBSETS))])

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            at, label = parts.indices.to_numpy(), batch.column(1).to_numpy()
            word = words[batch.column(2).to_numpy()]
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(len(parts.dictionary) + 1))
            for k, part in enumerate(parts.dictionary.to_pylist()):
                rows = order[cuts[k] : cuts[k + 1]]
                for kind in range(3):
                    own = rows if not kind else rows[label[rows] & kind > 0]
                    sums[part, kind] = sums.get((part, kind), 0) + positional_counts(word[own])
            if len(sums) >= 3 * MOST_PARTS:
                yield emitted()
        yield emitted()

    counted = rows.mapInArrow(added, schema).groupBy("part", "kind").agg(*(F.sum(f"n{s}").alias(f"n{s}") for s in range(N_SUBSETS)))
    counts = F.array(*(F.col(f"n{s}") for s in range(N_SUBSETS)))
    return counted.groupBy("part").agg(*(F.max(F.when(F.col("kind") == k, counts)).alias(c) for k, c in enumerate(("all", "good", "toxic"))))


def orders() -> Column:
    """All orders and steps as an array of structs, with the subset before each step and the bit of its filter."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            steps.append(f"('{''.join(order)}', {step}, {before}, {bit})")
            before |= bit
    return F.explode(F.expr("array(" + ", ".join(f"struct{s}" for s in steps) + ")"))


def shapley(count: Column) -> Column:
    """Array by filter: what it removes, summed over all orders. Each subset before it occurs in |S|! (4 - |S|)! orders."""
    n = len(FILTERS)

    def removed(k: int) -> Column:
        free = [s for s in range(N_SUBSETS) if not s >> k & 1]
        orders_with = {s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in free}
        return sum((F.lit(orders_with[s]) * (count[s] - count[s | 1 << k]) for s in free), F.lit(0))

    return F.array(*(removed(k) for k in range(n)))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    Parts are the values of ``part_col``, a null among the empty string. Null texts are empty; rows with the same id
    and the same text are no copies of a smaller id; a null id is the smallest long and has no labels. An empty
    table has no parts and gives no rows; without labels nothing good or toxic is lost.
    """
    counts = survivors(failures(docs, id_col, text_col, part_col), labels, id_col)
    rows = counts.withColumn("by_filter", shapley(F.col("all"))).select("*", orders().alias("at"))
    every, before, bit = N_SUBSETS - 1, F.col("at.col3"), F.col("at.col4")
    after = before.bitwiseOR(bit)
    number = F.log2(bit.cast("double")).cast("int")
    removed = F.col("all")[before] - F.col("all")[after]
    lost = [(F.col(c)[before] - F.col(c)[after]).alias(f"{c}_lost") for c in ("good", "toxic")]
    return rows.select(
        "part",
        F.col("at.col1").alias("filter_order"),
        F.col("at.col2").cast("int").alias("step"),
        F.col("all")[after].alias("kept"),
        removed.alias("removed"),
        (F.col("all")[0] - F.col("all")[bit] - removed).alias("redundant"),
        (F.col("all")[F.lit(every) - bit] - F.col("all")[every]).alias("unique_fails"),
        *lost,
        F.col("by_filter")[number].cast("long").alias("shapley"),
    )


def audit_sql() -> str:
    """The same by counting every document at every step of every order, for DuckDB."""
    letters = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate(FILTERS))
    return f"""
WITH judged AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
masks AS (
  SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS failed
  FROM judged),
counted AS (
  SELECT part, failed, count(*) AS n, coalesce(sum(quality), 0) AS n_good, coalesce(sum(toxic), 0) AS n_toxic
  FROM masks LEFT JOIN labels USING (doc_id) GROUP BY part, failed),
letters(letter, bit) AS (VALUES {letters}),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = {N_SUBSETS - 1}),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
sums AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN failed & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & earlier = 0 AND failed & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed & earlier > 0 AND failed & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed & earlier = 0 AND failed & bit > 0 THEN n_good ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & earlier = 0 AND failed & bit > 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM sums"""
