"""Document fingerprints from spot signatures.

A signature starts at an anchor, a very common word, and is the chain of content words that follow it. Navigation,
lists and boilerplate hold few anchors, so signatures come from running text. A fingerprint is the sorted set of a
text's signatures; two are compared by their Jaccard similarity, pruned by their lengths.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.common import key_columns, per_row, small_batches, texts

#: Common function words of English, German, French and Spanish.
ANCHORS = frozenset(
    """a an the is was are were be been to of in on at by for with from as and or not this that it he she they
    der die das ein eine und oder ist war sind im in von zu mit auf für den dem des nicht als auch
    le la les un une et ou est de du des en dans pour par sur que qui au aux pas avec
    el la los las un una y o es de del en para por con que no se su al""".split()
)
CHAIN, DISTANCE = 2, 1
REMEMBERED = 500_000
WORD = re.compile(r"\w+")
PRIME = np.uint64(0x9E3779B97F4A7C15)
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"


class Words(dict):
    """Hash of a word; the lowest bit marks anchors."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        value = self[word] = value | 1 if word in ANCHORS else value & ~1
        return value


@lru_cache(1)
def known_words() -> Words:
    return Words()


def signatures(text: str, chain: int = CHAIN, distance: int = DISTANCE) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a text.

    Each anchor is followed by ``chain`` content words, every ``distance``-th after it. A text in which no
    anchor has a whole chain takes every word as an anchor, with as many of the words after it as there are.
    """
    words = WORD.findall(text.lower())
    hashes = np.fromiter(map(known_words().__getitem__, words), np.uint64, len(words))
    anchor = (hashes & np.uint64(1)).astype(bool)
    content = np.flatnonzero(~anchor)
    spots = np.flatnonzero(anchor)
    first = np.searchsorted(content, spots)
    whole = first + (chain - 1) * distance < len(content)
    spots, first = spots[whole], first[whole]
    if len(spots):
        value = hashes[spots]
        for k in range(chain):
            value = value * PRIME + hashes[content[first + k * distance]]
    else:
        value = hashes.copy()
        for k in range(1, chain + 1):
            following = np.zeros(len(hashes), np.uint64)
            following[: max(0, len(hashes) - k)] = hashes[k:]
            value = value * PRIME + following
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((value >> np.uint64(32)).astype(np.uint32))


def written(values: np.ndarray) -> str:
    """A fingerprint: eight hexadecimal digits for each signature, ascending; empty for a text without words."""
    return values.astype(">u4").tobytes().hex()


def likeness(left: np.ndarray, right: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 where their lengths alone keep it below ``least``. Two empty sets are alike."""
    small, large = sorted((len(left), len(right)))
    if not large:
        return 1.0
    if small < least * large or not small:
        return 0.0
    both = len(np.intersect1d(left, right, assume_unique=True))
    value = both / (small + large - both)
    return value if value >= least else 0.0


def fingerprints(docs: DataFrame, chain: int = CHAIN, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint, n_signatures. A null text is empty; equal texts have equal fingerprints."""

    def batch_rows(batch):
        import pyarrow as pa

        found = [signatures(t, chain, distance) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([written(s) for s in found], pa.string()), pa.array([len(s) for s in found], pa.int64())], ["doc_id", "fingerprint", "n_signatures"])

    return texts(docs, id_col, text_col).mapInArrow(per_row(batch_rows), "doc_id long, fingerprint string, n_signatures long")


def in_descending_runs(docs: DataFrame, runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt into runs of neighbouring ids, each followed by the row that comes next after it.

    Columns: run, follows (whether the row only follows the run), key_id, key_hash, text; each partition sorted by
    descending id within its runs. Only the bounds of the runs and their first ids reach the driver. After the
    last run follows the first row of all.
    """
    rows = docs.select(*key_columns(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = docs.select(*key_columns(id_col, text_col))
    bounds = sorted(set(ids.select(F.col("key_id").alias("k")).approxQuantile("k", [i / runs for i in range(1, runs)], 0.2 / runs))) if runs > 1 else []
    run = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b < F.col("key_id"))) if bounds else F.lit(0)
    heads = ids.select(run.alias("run"), F.struct("key_id", "key_hash").alias("key")).groupBy("run").agg(F.max("key").alias("key")).orderBy(F.desc("run")).collect()  # one row a run
    before = [heads[-1], *heads[:-1]] if heads else []
    following = [(h.key.key_id, h.key.key_hash, b.run) for h, b in zip(heads, before, strict=True)]
    follow = docs.sparkSession.createDataFrame(following, "key_id long, key_hash long, after int")
    places = F.array(F.struct(run.cast("int").alias("run"), F.lit(False).alias("follows")), F.struct(F.col("after").alias("run"), F.lit(True).alias("follows")))
    dealt = rows.join(F.broadcast(follow), ["key_id", "key_hash"], "left").select(F.explode(F.filter(places, lambda p: p.run.isNotNull())).alias("place"), "key_id", "key_hash", "text")
    dealt = dealt.select("place.run", "place.follows", "key_id", "key_hash", "text")
    return dealt.repartition(runs, "run").sortWithinPartitions("run", "follows", F.desc("key_id"), F.desc("key_hash"))


def fingerprint_edits(docs: DataFrame, chain: int = CHAIN, distance: int = DISTANCE, runs: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited form keeps a text but for its last floor(n/2) characters, for which it takes as many (or all) first
    characters of the next document by descending id; after the last comes the first. One row per input row:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures. A null id is the
    smallest; rows of one id are ordered by a hash of their text; a null text is empty. ``runs`` is the number of
    pieces of the id order, by default twice the shuffle partitions.
    """
    pieces = runs or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def edited(batches):
        import hashlib

        import pyarrow as pa

        last = None  # run, id, text, signatures
        closed = None
        for batch in small_batches(batches, "text"):
            rows = []
            for run, follows, key_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if follows and run == closed:
                    continue  # a row that repeats the one that follows
                own = signatures(text, chain, distance)
                if last is not None and last[0] == run:
                    n = len(last[2])
                    changed = last[2][: n - n // 2] + text[: n // 2]
                    other = signatures(changed, chain, distance)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((last[1] if last[1] != -(2**63) else None, n, digest, written(last[3]), written(other), likeness(last[3], other), likeness(last[3], own), len(last[3])))
                last = (run, key_id, text, own)
                if follows:
                    closed = run
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [part.split()[0] for part in EDITED.split(", ")])

    return in_descending_runs(docs, pieces, id_col, text_col).mapInArrow(edited, EDITED)
